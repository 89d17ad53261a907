"""Personal information in free text (problem 1).

``find`` locates e-mail addresses, phone numbers, identity numbers, street
addresses and personal names by their form, their checks and what stands
around them; ``redact`` puts typed placeholders in their place and leaves the
rest of the text as it is.

A full name counts by its given name, by initials, by a title or by words that
announce a person ("met with", "told by") or join two.  Given names are those
of a short fixed list and those learned from the author columns of the whole
corpus, which ``learn_given`` counts.

Placeholders carry pseudonyms: a keyed Feistel permutation over exactly the
values of a datum's format.  A phone number becomes another number of the same
shape; in an identity number a date becomes a valid date, the country stays and
checks that were right are right again (resident number, DNI and NIE, IBAN, CPF,
French number, cards); e-mail addresses, names and addresses become other
letters and digits in the same places.  The same value has the same pseudonym in
every document however it is spaced or cased.  The key is a required argument;
with it, and only with it, ``restore`` leads back to the normalised value.

Defined results: null gives null and no findings; empty text is left empty;
overlapping findings are resolved by kind (e-mail, address, id, phone, name),
the earlier and longer first; a value that is repeated in a text is reported
once and replaced everywhere; texts of any length are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.name_links import read_name
from docsieve.sources.settle import settle

MIN_SHARE = 2e-5  # of all spellings that a learned given name has: at most 1 / MIN_SHARE names
MIN_COUNT = 3

# Common given names of several languages.
GIVEN_NAMES = set(
    """
    abigail alexander alice andrea andreas anna anne antonio ayumi barbara bernard brigitte carlos carmen catherine charles charlotte chinwe christian
    christine christopher claire claudia clara daniel david dagmar deborah diana diego dolores dorothy eduardo edward elena elizabeth emily emma eric
    ernst esteban eva farid fatima felix fernando florian francisco francois frank frederika friedrich gabriel gabriele george gerhard giovanni hannah
    hans heinrich helen helena henri henrike henry hiro hiroshi ines ingeborg ingrid isabel ivan ivo jack jacqueline james jan jane javier jean jennifer
    jessica joao johann johannes john jonas jorge jose josef joseph josephine juan julia julie karen karl katharina kenji klaus lakshmi laura leopold
    linda louis louise lucas lucia luis luisa manuel margaret maria marie mario marta martin mary matthew mehmet michael michel miguel mireille mohammed
    monika nancy natalia nathaniel nicolas nikolaus nina odile olga oliver oluwaseun oscar pablo pascal patricia patrick paul paula pedro penelope peter
    philip pierre quentin rachel raquel rebecca ricardo richard robert rosa ruth samuel sandra sara sebastian simon sofia sophie stefan stephen susan
    teresa theodore thomas tomas ulrich ursula valentina viktor vincent wanda werner william wolfgang xanthe yevgenia yuki zacharias
    """.split()
)
# Words that announce a name, titles first; street words; what opens a place of two words.
TITLES = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Mme|Mlle|Hr|Fr|Sr|Sra|Srta|Dra|Ing|Mag)\.?|Professor|Professeur|Herrn?|Frau|Monsieur|Madame|[Dd]octora?|[Dd]octeur|Señora?|Senhora?|Dona?)"
CUES = r"(?:Signed|Gezeichnet|Signé|Firmado|Sincerely|Regards|cc|Cc|CC|Sender|Patient|Patientin|Paciente|Ask|Contact|Contacto|Contato|Kontakt|Ansprechpartner|Author|Name|Nom|Nombre|Selon|Zuständig ist|联系人是|联系人|联系方式|签名|由)"
# What comes before a person that is talked of, and what joins two.
TALK = r"(?:[Mm]et(?: with)?|[Tt]old by|[Tt]old|[Ss]poke (?:to|with)|[Tt]alked (?:to|with)|[Aa]sked|[Ee]-?mailed|[Cc]ontacted|[Cc]ontact|[Ww]rote to|[Ww]rite to|[Cc]alled|[Aa]ccording to|[Oo]n behalf of|c/o|[Gg]espräch mit|[Ll]aut|[Tt]raf|[Ss]elon|[Aa]près avis de|[Ss]egún|[Hh]abl[óé] con|[Ss]egundo|[Ff]alei com)"
JOINS = r"(?:and|or|und|oder|et|ou|y|o|e|&)"
_EN_STREET = r"(?:Street|St\.|Road|Rd\.?|Lane|Avenue|Ave\.?|Drive|Close|Way|Court|Square|Terrace|Crescent|Boulevard|Gardens|Hill|Row|Mews)"
_FR_STREET = r"(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)"
_DE_STREET = r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|stieg)"
_ES_STREET = r"(?:Calle|C/|Avenida|Av\.|Plaza|Paseo|Camino|Carrera)"
_PT_STREET = r"(?:Rua|Avenida|Av\.|Travessa|Praça|Largo|Estrada|Alameda)"
_PLACE_HEAD = r"(?:Sankt|St\.?|Saint|Sainte|San|Santa|Santo|São|Bad|New|Los|Las|La|Le|Les|El|Porto|Rio|Nova|Vila|North|South|East|West|Great|Upper|Lower|Port|Fort|Mount|Ober|Unter|Alt|Neu)"

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
_PLACE = rf"(?:{_PLACE_HEAD}[ -])?{_CAP}"
_STREET = rf"(?:{_CAP}\s)*{_CAP}"
_D = "0-9０-９"
_ADDRESS = re.compile(
    "|".join(
        [
            rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s+\d+[A-Za-z]?,\s+)?\d{{1,5}}[A-Za-z]?\s+{_STREET}\s{_EN_STREET}(?:,\s+{_PLACE}(?:,?\s+(?:\d{{4,5}}\b|[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}}\b))?)?",
            rf"\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+{_FR_STREET}\s+(?:(?:de|du|des|d['’])\s?(?:la\s|l['’])?)?{_STREET}(?:,\s+\d{{5}}\s+{_PLACE}|,\s+{_PLACE})?",
            rf"(?:[A-ZÀ-ÖØ-Þ][\w-]*{_DE_STREET}|{_CAP}(?:er|[ -])?\s?(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer))\s+\d{{1,4}}\s?[a-z]?\b(?:,\s+(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s+{_PLACE}|,\s+{_PLACE})?",
            rf"{_ES_STREET}\s+(?:(?:de|del|la|las|los)\s)*{_STREET},?\s+\d{{1,4}}(?:,\s+\d{{1,2}}\.?[ºªo]\s?[A-Za-z]?\b)?(?:,\s+\d{{5}}\s+{_PLACE}|,\s+{_PLACE})?",
            rf"{_PT_STREET}\s+(?:(?:de|da|do|das|dos)\s)*{_STREET},\s+(?:n\.?[ºo]\s?)?\d{{1,4}}(?:,\s+\d{{1,2}}\.?[ºª]\s?\w*)?(?:,\s+\d{{4,5}}(?:-\d{{3}})?\s+{_PLACE}|,\s+{_PLACE})?",
        ]
    )
)
_AT = r"(?:\s?[@＠]\s?|\s?[\(\[\{]\s?(?:at|AT|ät|arroba)\s?[\)\]\}]\s?)"
_DOT = r"(?:[.．]|\s?[\(\[\{]\s?(?:dot|DOT|punkt|point|punto|ponto)\s?[\)\]\}]\s?)"
_L = r"[A-Za-z0-9_%+-]"
_EMAIL = re.compile(
    rf"(?<![\w.+-]){_L}+(?:[.]{_L}+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+|(?<![\w.+-]){_L}+(?:(?:[.]| dot ){_L}+)*\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9-]+)+".replace(r"\w", "A-Za-z0-9_")
)
_PHONE = re.compile(
    rf"(?<![\w+./-])(?:"
    rf"(?:[+＋]|00)\s?[{_D}](?:[ ()./-]{{0,2}}[{_D}]){{7,14}}"
    rf"|\([{_D}]{{3,5}}\)\s?[{_D}]{{3,4}}[ .-]?[{_D}]{{3,5}}"
    rf"|[{_D}]{{3}}[.-][{_D}]{{3}}[.-][{_D}]{{4}}|[{_D}]{{3}}\s[{_D}]{{3}}\s[{_D}]{{4}}"
    rf"|[0０][1-9１-９](?:[ .][{_D}]{{2}}){{4}}"
    rf"|[0０][1-9１-９][{_D}]{{1,4}}(?:\s?[/-]\s?|\s)[{_D}]{{2,5}}(?:[ -]?[{_D}]{{2,5}}){{0,3}}"
    rf"|[0０][1-9１-９][{_D}]{{8,9}}"
    rf")(?![\w]|[-–./][{_D}])"
)
_ID = re.compile(
    r"(?<![\w./-])(?:"
    r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"  # national insurance
    r"|\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}"  # social security
    r"|\d{6}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"  # resident identity
    r"|[XYZ]?\d{7,8}-?[A-HJ-NP-TV-Z]"  # national identity with a check letter
    r"|[A-Z]\d{8}|[A-Z]{2}\d{7}|[A-Z]\d{3}\s?\d{3}\s?\d{3}"  # passports, cards
    r"|\d{4}([ -])\d{4}\1\d{4}\1\d{3,4}|\d{3}\.\d{3}\.\d{3}-\d{2}|[12]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?"
    r"|[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,3})?"
    r")(?![\w]|[-./]\d)"
)
_CUED_ID = re.compile(
    r"(?i)(?:passport|passeport|pasaporte|passaporte|reisepass|ausweis|identity|identité|identidad|identidade|national id|insurance|versicherung|sécurité sociale|id card|id no|ssn|社保|身份证|护照|证件)"
    r"[^\d\n]{0,24}?(?<![\w-])([A-Z]{0,3}\d[\dA-Z]{5,14}[A-Z\d])(?![\w-])"
)
_SURNAME = r"(?:(?:von|van|de|di|da|del|der|den|le|la)\s){0,2}[A-ZÀ-ÖØ-Þ](?:[a-zà-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ'’]+)(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?"
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
_G = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?"
_NAME = re.compile(
    rf"(?<![\w@.&/-])(?:(?P<given>{_G})(?:\s[\"“(][^\"”()\n]{{2,20}}[\"”)])?(?:\s{_INITIAL})*\s(?P<last>{_SURNAME})"
    rf"|(?P<caps>[A-ZÀ-ÖØ-Þ'’-]{{3,}}),?\s(?P<given2>{_G})(?:\s{_INITIAL}(?=\W|$))*"
    rf"|(?P<initials>(?:{_INITIAL}\s?){{1,3}})\s?(?P<last2>{_SURNAME}))(?![\w@])"
)
_CUED = re.compile(rf"(?:(?<!\w){TITLES}\s+(?:{TITLES}\s+)*|(?<!\w){CUES}\s?[:,：]?\s?)(?P<name>(?:(?:{_G}|{_INITIAL})\s){{0,3}}{_SURNAME})(?![\w@])")
_TALKED = re.compile(rf"(?<!\w){TALK}\s+(?P<name>{_G}(?:\s{_INITIAL})*\s{_SURNAME})(?![\w@])")
_JOINED = re.compile(rf"\s*,?\s{JOINS}\s(?P<name>{_G}(?:\s{_INITIAL})*\s{_SURNAME})(?![\w@])")
_NO_PERSON = re.compile(r"(?i)^(?:.*(?:schaft|heit|keit|ung|ismus|tion|ology|ologie|istik|graphy|grafía)|university|institute|institut|department|centre|center|laboratory|journal|society|college|school|faculty|hospital|archive|annals|letters|review|press|acta|international|national|royal|studies|research|sciences?|methods?|systems?|table|figure|section|appendix|chapter|street|road|saint|sankt|san|new|north|south|east|west)$")
_TITLED = re.compile(rf"(?<!\w){TITLES}\s+(?:{TITLES}\s+)*$")
_BEFORE_INITIAL = re.compile(r"(?:[\d°µ/%]|\b(?:appendix|anhang|annexe|anexo|apéndice|table|figure|section|panel|group|grade|vitamin|hepatitis|type|class|series|site))\s*$", re.I)
# Words that begin sentences or name things, never persons.
NOT_NAMES = set(
    """
    the this that these those it its he she they we you after before although however panels panel coverage note notes please similarity values reviewers
    row grant figure table section page site lane accessed see call tel telephone phone fax mail email postal address contact sender signed patient ask
    insurance national passport parcels send interview case my a an in on for with from and or but not der die das ein eine nach auf zwischen weil ob dabei
    insgesamt es le la les un une entre pour selon cependant bien el los las una aunque hemos según en por o os as um uma institute university department
    centre center laboratory journal letters test scale index method model street road corpus archive society press
    """.split()
)


def _norm(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _digits(text: str) -> str:
    return "".join(c for c in _norm(text) if c.isdigit())


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _phone_ok(value: str) -> bool:
    d = _digits(value)
    n = len(d)
    if not 9 <= n <= 15 or re.search(r"(?:19|20)\d\d-\d\d-\d", value):
        return False
    plain = _norm(value).strip()
    if plain.startswith("+") or plain.startswith("00"):
        return n >= 9 and not d.startswith("000")
    return d[0] == "0" and 10 <= n <= 12 or n == 10


def find(text: str | None, given_names: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each personal datum, in order, without overlaps; ``given_names``: folded names beside the fixed ones."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y, _ in taken)

    def take(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1] in ".,;:!? \n\t":
            b -= 1
        if b > a and free(a, b):
            taken.append((a, b, kind))

    if "@" in text or "＠" in text or re.search(r"(?i)\bat\b|ät|arroba", text):
        for m in _EMAIL.finditer(text):
            take(m.start(), m.end(), "email")
    for m in _ADDRESS.finditer(text):
        if free(m.start(), m.end()) and re.search(r"\d", m.group()) and ("," in m.group() or re.match(r"\d", m.group())):
            take(m.start(), m.end(), "address")
    for m in _ID.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()].lower()
        if not re.search(r"(?:issn|isbn|doi|grant|manuscript|sample|batch|reference|file)\W*$", before):
            take(m.start(), m.end(), "id")
    for m in _PHONE.finditer(text):
        if _phone_ok(m.group()):
            take(m.start(), m.end(), "phone")
    for m in _CUED_ID.finditer(text):
        take(m.start(1), m.end(1), "id")
    at = 0
    while m := _NAME.search(text, at):
        at = m.end()
        given = m.group("given") or m.group("given2")
        a, b = m.start(), m.end()
        if given:
            last = m.group("last") or m.group("caps")
            if (_fold(given) in GIVEN_NAMES or _fold(given) in given_names) and _fold(last) not in NOT_NAMES:
                take(a, b, "name")
                continue
            at = a + len(m.group().split()[0])  # the next word may begin a name
            continue
        if _BEFORE_INITIAL.search(text[max(0, a - 14) : a]) or _fold(m.group("last2")) in NOT_NAMES or len(m.group("last2")) < 3:
            at = a + 2
            continue
        take(a, b, "name")
    for m in _CUED.finditer(text):
        a, b = m.span("name")
        words = m.group("name").split()
        titled = _TITLED.search(text[:a]) is not None
        if (len(words) >= 2 or titled) and not any(_fold(w.strip(".")) in NOT_NAMES for w in words):
            take(a, b, "name")
    for m in _TALKED.finditer(text):
        if _person(m.group("name")):
            take(*m.span("name"), "name")
    for b in sorted(b for _, b, kind in taken if kind == "name"):
        while (m := _JOINED.match(text, b)) and _person(m.group("name")) and free(*m.span("name")):
            take(*m.span("name"), "name")
            b = m.end()
    return sorted(taken)


def _person(words: str) -> bool:
    """Whether capitalised words can be a person: none begins sentences or names things."""
    return not any(_fold(w.strip(".")) in NOT_NAMES or _NO_PERSON.match(w) for w in words.split())


# --- pseudonyms ---------------------------------------------------------------------------------


def permute(value: int, size: int, key: str, tweak: str, back: bool = False) -> int:
    """Keyed permutation of 0..size-1 or its inverse: an eight-round Feistel network on the next even power of two, walked until it stays inside."""
    if size <= 1:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    secret = hashlib.sha256(key.encode()).digest()

    def f(r: int, right: int) -> int:
        return int.from_bytes(hashlib.shake_256(secret + f"{tweak}|{size}|{r}|{right}".encode()).digest(width), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            if back:
                left, right = right ^ f(7 - r, left), left
            else:
                left, right = right, left ^ f(r, right)
        value = (left << half) | right
        if value < size:
            return value


# Alphabets whose members stand for each other, beside which all characters stay; each is a range or a rule.
_LATIN = [chr(c) for c in range(0xDF, 0x250)]
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(c for c in _LATIN if c.islower()), "".join(chr(c) for c in range(0x4E00, 0x9FA6)), "".join(chr(c) for c in range(0x430, 0x450))]
_PLACE_OF = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


def permute_characters(text: str, key: str, tweak: str, back: bool = False) -> str:
    """Another string of the same format: digits stay digits, letters letters of the same case and script, all else stays."""
    size, value = 1, 0
    for c in text:
        if place := _PLACE_OF.get(c):
            value = value * len(place[0]) + place[1]
            size *= len(place[0])
    value = permute(value, size, key, tweak, back)
    out = []
    for c in reversed(text):
        if place := _PLACE_OF.get(c):
            value, d = divmod(value, len(place[0]))
            c = place[0][d]
        out.append(c)
    return "".join(reversed(out))


_EPOCH, _LAST = datetime.date(1800, 1, 1), datetime.date(2099, 12, 31)


def permute_date(day: datetime.date, key: str, back: bool = False) -> datetime.date:
    """Another day of the three centuries from 1800, which hold every date that ``find`` takes for one; others stay."""
    if not _EPOCH <= day <= _LAST:
        return day
    return _EPOCH + datetime.timedelta(days=permute((day - _EPOCH).days, (_LAST - _EPOCH).days + 1, key, "date", back))


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def resident_check(first: str) -> str:
    """Check character of an 18-place resident identity number (modulus 11-2)."""
    return "10X98765432"[sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(first)) % 11]


def dni_check(digits: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23]


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number (modulus 97-10)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def cpf_check(nine: str) -> str:
    """The two check digits of a Brazilian number."""
    out = nine
    for _ in range(2):
        r = sum(int(c) * w for c, w in zip(out, range(len(out) + 1, 1, -1), strict=True)) * 10 % 11
        out += str(r % 10)
    return out[9:]


def french_check(thirteen: str) -> str:
    return f"{97 - int(thirteen) % 97:02d}"


def _in_range(text: str, low: int, high: int, key: str, tweak: str, back: bool) -> str:
    """Another number from ``low`` to ``high`` in as many digits; one outside keeps its digits' format only."""
    n = int(text)
    if not low <= n <= high:
        return permute_characters(text, key, tweak, back)
    return f"{low + permute(n - low, high - low + 1, key, tweak, back):0{len(text)}d}"


def pseudonym_id(value: str, key: str, back: bool = False) -> str:
    """Another identity number of the same format; a check that was right is right again."""
    bare = "".join(c for c in value if c.isalnum()).upper()

    def checked(body: str, check: str, right: str, compute, tweak: str) -> str:
        """The new body with the check that fits, where the old one did; a wrong check is permuted among the wrong ones' format."""
        return body + (compute(body) if check == right else permute_characters(check, key, f"{tweak} check", back))

    if re.fullmatch(r"\d{17}[\dX]", bare):
        try:
            day = permute_date(datetime.datetime.strptime(bare[6:14], "%Y%m%d").date(), key, back).strftime("%Y%m%d")
        except ValueError:
            day = permute_characters(bare[6:14], key, "id", back)
        body = permute_characters(bare[:6], key, "region", back) + day + permute_characters(bare[14:17], key, "serial", back)
        new = body + (resident_check(body) if resident_check(bare[:17]) == bare[17] else bare[17])  # a wrong check character stays
    elif re.fullmatch(r"\d{8}[A-Z]", bare):
        new = checked(permute_characters(bare[:8], key, "dni", back), bare[8], dni_check(bare[:8]), dni_check, "dni")
    elif re.fullmatch(r"[XYZ]\d{7}[A-Z]", bare):
        lead = "XYZ".index(bare[0])
        body = permute(lead * 10**7 + int(bare[1:8]), 3 * 10**7, key, "nie", back)
        digits = f"{body:08d}"
        new = "XYZ"[body // 10**7] + digits[1:] + (dni_check(digits) if dni_check(f"{lead}{bare[1:8]}") == bare[8] else permute_characters(bare[8], key, "nie check", back))
    elif re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", bare):
        account = permute_characters(bare[4:], key, f"iban {bare[:2]}", back)
        valid = iban_check(bare[:2], bare[4:]) == bare[2:4]
        new = bare[:2] + (iban_check(bare[:2], account) if valid else permute_characters(bare[2:4], key, "iban check", back)) + account
    elif re.fullmatch(r"\d{11}", bare) and re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", value.strip()):
        new = checked(permute_characters(bare[:9], key, "cpf", back), bare[9:], cpf_check(bare[:9]), cpf_check, "cpf")
    elif re.fullmatch(r"[12]\d{12}(?:\d{2})?", bare):
        born = _in_range(bare[1:3], 0, 99, key, "fr year", back) + _in_range(bare[3:5], 1, 12, key, "fr month", back)
        body = _in_range(bare[0], 1, 2, key, "fr sex", back) + born + _in_range(bare[5:7], 1, 95, key, "fr department", back) + _in_range(bare[7:10], 1, 990, key, "fr commune", back) + _in_range(bare[10:13], 1, 999, key, "fr order", back)
        new = checked(body, bare[13:], french_check(bare[:13]), french_check, "fr") if bare[13:] else body
    elif re.fullmatch(r"\d{9}", bare):
        new = _in_range(bare[:3], 1, 665, key, "ssn area", back) + _in_range(bare[3:5], 1, 99, key, "ssn group", back) + _in_range(bare[5:], 1, 9999, key, "ssn serial", back)
    elif re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", bare):
        new = permute_characters(bare[:8], key, "nino", back) + "ABCD"[permute("ABCD".index(bare[8]), 4, key, "nino suffix", back)]
    elif bare.isdigit() and len(bare) >= 13 and luhn(bare[:-1]) == int(bare[-1]):
        body = permute_characters(bare[:-1], key, "card", back)
        new = body + str(luhn(body))
    else:
        new = permute_characters(bare, key, "id", back)
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in value)


PHONE_DIGITS = 9  # the last digits of a number, which every way of writing it shares


def pseudonym_phone(value: str, key: str, back: bool = False) -> str:
    """The same number with its last nine digits permuted (all but one of a shorter one): the same ones however the number is written."""
    digits = _digits(value)
    n = min(PHONE_DIGITS, max(len(digits) - 1, 1))
    new = iter(digits[:-n] + permute_characters(digits[-n:], key, "phone", back))
    return "".join(next(new) if _norm(c).isdigit() else c for c in _norm(value))


def normal_form(value: str, kind: str) -> str:
    """What of a value its pseudonym stands for: e-mail addresses, names and addresses without regard to case, width and spacing."""
    if kind in ("phone", "id"):
        return value
    flat = re.sub(r"\s+", " ", _norm(value).casefold())
    if kind == "email":
        flat = re.sub(r"\s*[\(\[\{]\s*(?:at|ät|arroba)\s*[\)\]\}]\s*|\s+at\s+|\s*@\s*", "@", flat)
        flat = re.sub(r"\s*[\(\[\{]\s*(?:dot|punkt|point|punto|ponto)\s*[\)\]\}]\s*|\s+dot\s+", ".", flat)
    return flat


def pseudonym(value: str, kind: str, key: str, back: bool = False) -> str:
    """What the placeholder of a value carries; with ``back`` the normalised value that a pseudonym stands for."""
    if not key:
        raise ValueError("pseudonyms need a key")
    if kind == "phone":
        return pseudonym_phone(value, key, back)
    if kind == "id":
        return pseudonym_id(value, key, back)
    flat = value if back else normal_form(value, kind)
    if kind == "email" and "." in flat:  # the top-level domain stays
        head, _, top = flat.rpartition(".")
        return permute_characters(head, key, kind, back) + "." + top
    return permute_characters(flat, key, kind, back)


def restore(value: str, kind: str, key: str) -> str:
    """The normalised value behind a pseudonym."""
    return pseudonym(value, kind, key, back=True)


def redact(text: str | None, key: str, given_names: frozenset[str] = frozenset()) -> str | None:
    """``text`` with typed placeholders for every personal datum."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text, given_names):
        out += [text[at:a], f"<{kind.upper()} {pseudonym(text[a:b], kind, key)}>"]
        at = b
    return "".join([*out, text[at:]])


def learn_given(spellings: DataFrame) -> frozenset[str]:
    """Folded given names that enough spellings of persons state; ``spellings`` has one column ``name``.  At most ``1 / MIN_SHARE`` of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(_fold(n.given), c) for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (n := read_name(t)) and n.kind == "person" and len(n.given) > 2 and n.surname]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["given", "n"])

    names = spellings.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))
    counts = settle(names.mapInArrow(read, "given string, n bigint").groupBy("given").agg(F.sum("n").alias("n")), "given-names")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, int(total * MIN_SHARE))
    return frozenset(r.given for r in counts.where(F.col("n") >= least).select("given").collect()) - NOT_NAMES


def find_personal(df: DataFrame, key: str, fields: list[str], given_names: frozenset[str] = frozenset()) -> DataFrame:
    """(key, field, kind, value): one row for each personal datum in each of ``fields``."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(given_names)  # at most 1 / MIN_SHARE names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, field, kinds, values = [], [], [], []
            for j, name in enumerate(fields, 1):
                for i, t in enumerate(b.column(j).to_pylist()):
                    for s, e, k in find(t, sent.value):
                        at.append(i), field.append(name), kinds.append(k), values.append(t[s:e])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=[key, "field", "kind", "value"])

    return df.select(key, *fields).mapInArrow(work, f"`{key}` {kind}, field string, kind string, value string").distinct()


def pseudonymise(found: DataFrame, secret: str) -> DataFrame:
    """The rows of ``find_personal`` with a column ``pseudonym``."""
    names = [*found.columns, "pseudonym"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [pseudonym(v, k, secret) for v, k in zip(b.column("value").to_pylist(), b.column("kind").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(work, f"{schema}, pseudonym string")


def redact_personal(df: DataFrame, fields: list[str], secret: str, given_names: frozenset[str] = frozenset()) -> DataFrame:
    """``df`` with the personal data in ``fields`` replaced by placeholders; other columns unchanged."""
    names = df.columns
    if not secret:
        raise ValueError("pseudonyms need a key")
    sent = df.sparkSession.sparkContext.broadcast(given_names)  # at most 1 / MIN_SHARE names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array([redact(t, secret, sent.value) for t in c.to_pylist()], pa.string()) if n in fields else c for n, c in zip(names, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(work, df.schema)
