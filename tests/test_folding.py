import time
import unicodedata

from pyspark.sql import functions as F

from strataframe.functions import text


def test_every_character_is_folded_as_by_its_normal_form(spark):
    chars = [chr(c) for c in [*range(0x20, 0xD800), *range(0xE000, 0x1FC00)]]
    rows = spark.createDataFrame([(" ".join(chars[i : i + 500]),) for i in range(0, len(chars), 500)], "t string")
    got = rows.select("t", text.fold_ascii(F.col("t")).alias("plain"), text.case_fold(F.col("t")).alias("folded")).collect()
    for r in got:
        assert r["plain"] == "".join(c for c in unicodedata.normalize("NFKD", r["t"]) if c.isascii())
        known = [(a, b) for a, b in zip(r["t"].split(" "), r["folded"].split(" "), strict=True) if a.lower() == a != a.casefold()]
        assert all(b == a.casefold() for a, b in known)


def test_long_texts_are_not_compared_with_every_character_that_is_spelt(spark):
    rows = spark.range(1).select(F.repeat(F.lit("Straße ﬁne-Á 7 "), 400_000).alias("t")).cache()
    rows.count()
    start = time.monotonic()
    n = rows.select(F.length(text.entity_key(F.col("t"))).alias("e"), F.length(text.name_key(F.col("t"))).alias("n")).first()
    assert tuple(n) == (11 * 400_000, 12 * 400_000)
    assert time.monotonic() - start < 10  # of 6 million characters; it was some 20 s
