import hashlib
import random
import uuid

from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators import split


def one(spark, col, **values):
    return spark.createDataFrame([values]).select(col.alias("x")).first()["x"]


def test_token_hash_is_frozen_and_case_sensitive(spark):
    rows = spark.createDataFrame([(w,) for w in ("test", "Test", "", "ünï")], "w string").select("w", X.token_hash(F.col("w")).alias("i")).collect()
    got = {r["w"]: r["i"] for r in rows}
    assert got["test"] == 1085751994
    assert got == {w: int(hashlib.md5(w.encode()).hexdigest(), 16) % 4294967295 for w in got}


def test_point_id_is_a_version_5_uuid(spark):
    space = uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890")
    rows = spark.createDataFrame([(f"doc/{i}.md",) for i in range(50)], "d string").select("d", X.point_id(F.col("d")).alias("p")).collect()
    assert all(r["p"] == str(uuid.uuid5(space, r["d"])) for r in rows)


def test_counts_and_slices(spark):
    assert one(spark, X.token_count(F.col("t")), t="") == 0
    assert one(spark, X.token_count(F.col("t")), t="abcde") == 2
    assert one(spark, X.char_slices(F.col("t"), 1), t="abcdefghi") == ["abcd", "efgh", "i"]
    assert one(spark, X.char_slices(F.col("t"), 1), t="") == []
    assert one(spark, X.strip(F.col("t")), t="  a b\n") == "a b"
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three?\nfour") == ["One.", "Two!", "Three?", "four"]


def test_header_blocks_equal_the_document_function(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["# ", "## ", "a", "\n", "\n", " ", "#", "b c"]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.header_blocks(F.col("t")).alias("b")).collect()
    for x in rows:
        assert x["b"] == split.by_headings(x["t"]), repr(x["t"])


def greedy(blocks, limit):
    out, used = [], 0
    for b in blocks:
        n = -(-len(b) // 4)
        if out and used + n <= limit:
            out[-1].append(b)
            used += n
        else:
            out.append([b])
            used = n
    return out


def test_pack_equals_a_plain_loop(spark):
    r = random.Random(5)
    cases = [["x" * r.randint(0, 60) for _ in range(r.randint(0, 12))] for _ in range(60)] + [[]]
    rows = spark.createDataFrame([(c,) for c in cases], "b array<string>").select("b", X.pack(F.col("b"), 10).alias("p")).collect()
    assert all(x["p"] == greedy(x["b"], 10) for x in rows)
    sizes = [[len(b) // 4 for b in p] for p in greedy(["x" * 4 * n for n in (5, 5, 5, 20, 3)], 12)]
    assert sizes == [[5, 5], [5], [20], [3]]


def test_media_type_and_verdicts(spark):
    assert one(spark, X.media_type(F.col("t")), t="https://h.x/a/b.JPG?v=1.png") == "image/jpeg"
    assert one(spark, X.media_type(F.col("t")), t="https://h.png") == "image/png"
    assert one(spark, X.verdict_comment(F.col("t")), t="1 | yes | no ") == "yes | no"
    assert one(spark, X.verdict_keep(F.col("t")), t="") is True
    assert one(spark, X.verdict_keep(F.col("t")), t="0") is False
    assert one(spark, X.display_name(F.col("t")), t="a/b/c.md") == "c.md"


def test_dates(spark):
    rows = spark.createDataFrame([(t,) for t in ("2024-01-15T10:00:00+00:00", "2024-01-15T13:00:00+03:00", "2024-01-15T10:00:00Z", "", "bad", "2024")], "t string")
    got = [r["x"] for r in rows.select(F.date_format(X.iso_time(F.col("t"), F.lit(None).cast("timestamp")), "HH:mm").alias("x")).collect()]
    assert got == ["10:00", "10:00", "10:00", None, None, None]


def test_cosine_of_a_zero_vector_is_zero(spark):
    assert one(spark, X.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert abs(one(spark, X.cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[1.0, 0.0]) - 0.5**0.5) < 1e-12
