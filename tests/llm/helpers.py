import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; none may clash with a caller's column.
CLASHING = ["n", "rep", "band", "fp", "a", "b", "cell", "v", "size", "crc", "old", "score", "kept", "key", "row", "pii", "shard", "slot", "rank", "label"]


def docs(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
