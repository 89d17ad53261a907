import pytest
from docsieve.operators.packed import source_scores, split_packed, split_value


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("  ", []),
        ("Lund, Ivo F.", ["Lund, Ivo F."]),
        ("Ada Lund; Berg, Ivo;; ; C. Holm", ["Ada Lund", "Berg, Ivo", "C. Holm"]),
        ('"Lund, Ada", Ivo Berg, "Kim ""K"" Holm"', ["Lund, Ada", "Ivo Berg", 'Kim "K" Holm']),
        ("Ada Lund, Ivo Berg and Kim Holm", ["Ada Lund", "Ivo Berg", "Kim Holm"]),
        ("1. Ada Lund, 2. Ivo Berg", ["Ada Lund", "Ivo Berg"]),
        ("(1) Ada Lund (2) Ivo Berg", ["Ada Lund", "Ivo Berg"]),
        ("Centre of Soil and Water Studies, Oslo / Ada Lund", ["Centre of Soil and Water Studies, Oslo", "Ada Lund"]),
        ("Ada Lund &amp; Ivo Berg", ["Ada Lund", "Ivo Berg"]),
    ],
)
def test_split_value(text, want):
    assert split_value(text) == want


def test_positions_and_edges(spark):
    rows = [("a", "Ada Lund|Ivo Berg", 1), ("b", None, 2), ("c", "", 3), ("d", "Ada Lund;Ada Lund", 4)]
    df = spark.createDataFrame(rows, "id string, authors string, pos int")  # a clashing extra column
    got = sorted(map(tuple, split_packed(df, "id", "authors").collect()))
    assert got == [("a", 1, "Ada Lund"), ("a", 2, "Ivo Berg"), ("d", 1, "Ada Lund"), ("d", 2, "Ada Lund")]
    assert split_packed(df.limit(0), "id", "authors").count() == 0


def test_source_prior(spark):
    df = spark.createDataFrame([("a", "Ada Lund; Ivo Berg", "s"), ("b", "Kim Holm; Bo Ek", "s"), ("c", "Lund, Ada", None)], "id string, authors string, src string")
    assert sorted(map(tuple, split_packed(df, "id", "authors", source="src").collect())) == [("a", 1, "Ada Lund"), ("a", 2, "Ivo Berg"), ("b", 1, "Kim Holm"), ("b", 2, "Bo Ek"), ("c", 1, "Lund, Ada")]


def test_long_value():
    assert len(split_value("; ".join(["Ada Lund"] * 3000))) == 3000


def test_any_number_of_quoted_values_and_private_characters():
    names = [f"Lund{i}, Ada" for i in range(4000)]
    assert split_value("; ".join(f'"{n}"' for n in names)) == names
    groups = ["Centre of Soil and Water Studies, Oslo"] * 4200
    assert split_value(" / ".join(groups)) == groups
    assert split_value('"Lund, \ue000 Ada"; Ivo \ue700 Berg; Kim \ue000 Holm') == ["Lund, \ue000 Ada", "Ivo \ue700 Berg", "Kim \ue000 Holm"]


def test_the_source_decides_rows(spark):
    inverted = [(f"a{i}", f"Lund{'abcdefghij'[i]}, Ada", "inverted") for i in range(10)]
    listed = [(f"b{i}", f"Ada Lund{'abcdefghij'[i]}, Ivo Berg", "listed") for i in range(10)]
    df = spark.createDataFrame([*inverted, *listed, ("x", "Lund, Ada Berg", "inverted"), ("y", "Lund, Ada Berg", "listed"), ("z", "Lund, Ada", None)], "id string, authors string, src string")
    got = {}
    for r in sorted(split_packed(df, "id", "authors", source="src").collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append(r.author)
    assert got["x"] == ["Lund, Ada Berg"] and got["y"] == ["Lund", "Ada Berg"] and got["z"] == ["Lund, Ada"]
    assert got["a3"] == ["Lundd, Ada"] and got["b3"] == ["Ada Lundd", "Ivo Berg"]
    top = {s: max((r.prior, r.delims) for r in source_scores(df, "authors", "src").collect() if r.src == s)[1] for s in ("inverted", "listed")}
    assert top == {"inverted": "", "listed": "comma"}
    assert split_packed(df.limit(0), "id", "authors", source="src").count() == 0


def test_many_kinds_of_delimiters():
    text = "Ada Lund; Ivo Berg | Kim Holm / Bo Ek & Una Dahl、Per Moe\tLiv Aas • Jon Vik"
    assert split_value(text) == ["Ada Lund", "Ivo Berg", "Kim Holm", "Bo Ek", "Una Dahl", "Per Moe", "Liv Aas", "Jon Vik"]
