"""docsieve: document-evidence analytics expressed as Spark DataFrame plans."""
