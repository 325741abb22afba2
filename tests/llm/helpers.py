"""Small document tables with the awkward cases that every operator must handle."""

AWKWARD = [
    (0, "one two three four five six", "en", "a", 27), (1, None, "en", "a", None), (2, "", None, None, 0),
    (3, " \t\n ", "de", "b", 4), (4, "one two\tthree  four five six", "en", "b", 28), (5, "short", "en", None, 5),
    (5, "short", "en", None, 5), (None, "short", None, "a", 5), (7, "word " * 3000, "en", "a", 15000),
    (8, "ü€😀 𝔘nicode text\x00 with odd\x85 blanks　here", "fr", "b", 40), (9, "one two three four five six", "es", "c", 27)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=""):
    """The rows above; ``extra`` names a further column that clashes with one of the operator."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.selectExpr("*", f"'mine' AS {extra}") if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
