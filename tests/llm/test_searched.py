"""Near-duplicates are searched by the distance tables of their fingerprints."""

import random

from pyspark.sql import functions as F

from sparkloom.llm import near_dups
from sparkloom.llm.simhash import shingle_hashes, simhash


def near_texts():
    """A text, others within two bits of its fingerprint, one similar but farther, and a stranger."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(300)]
    bits = lambda w: (simhash(shingle_hashes(" ".join(w), 5)) ^ simhash(shingle_hashes(" ".join(base), 5))).bit_count()
    near, far = {}, None
    while len(near) < 3 or far is None:
        other = [word() if i % 100 == len(near) and rng.random() < 0.5 else w for i, w in enumerate(base)]
        if bits(other) <= 2:
            near.setdefault(bits(other), other)
        elif bits(other) > 5:
            far = other
    return [" ".join(w) for w in (base, *near.values(), far, [word() for _ in range(300)])]


def test_distance_tables_find_without_views(spark, monkeypatch):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ids = lambda: sorted(r.doc_id for r in near_dups.keep_representatives(df).collect())
    assert ids() == [0, len(texts) - 1]
    # Without the views' postings only the search by distance is left.
    shared = near_dups.shared_postings
    monkeypatch.setattr(near_dups, "shared_postings", lambda postings: shared(postings).limit(0))
    assert ids() == [0, len(texts) - 2, len(texts) - 1]


def test_tables_discard_only_what_bits_would(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        x, flips = rng.getrandbits(64), sum(1 << b for b in rng.sample(range(64), rng.choice([0, 2, 23, 24, 25, 40, 64])))
        rows.append((x - 2**63, (x ^ flips) - 2**63, rng.choice([20, 400])))
    df = spark.createDataFrame(rows, "a bigint, b bigint, n int")
    side = lambda c: F.struct(F.col("n"), F.col(c).alias("fp"), F.get(near_dups.pivot_table(F.col(c)), F.lit(0)).alias("t0"), F.get(near_dups.pivot_table(F.col(c)), F.lit(1)).alias("t1"))
    found = df.withColumns({"x": side("a"), "y": side("b")}).select("a", "b", "n", near_dups._may_be_similar(0.8, F.col("x"), F.col("y")).alias("may")).collect()
    assert all(r.may == (r.n <= near_dups.FEW or (r.a ^ r.b) % 2**64 in range(2**64) and ((r.a ^ r.b) % 2**64).bit_count() <= near_dups.MOST_BITS) for r in found)
