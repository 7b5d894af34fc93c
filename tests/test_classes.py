"""Equivalence classes of copies."""

import random

import pytest

from strandframe.operators import quant

K = 5


def _made():
    r = random.Random(5)
    base = ["".join(r.choices("ACGT", k=30)) for _ in range(6)]
    base = [*base, base[0][:15] + base[1][:15], "A" * 30, "A" * 12 + base[2][:12], "ACG"]
    transcripts = [(i, base[i % len(base)]) for i in range(40)] + [(50, None), (3, base[4])]  # copies; none; two of one key
    reads = [(i, (s := r.choice(base))[(a := r.randint(0, 12)): a + r.randint(3, 16)]) for i in range(60)]
    reads += [(100 + i, base[0][:9]) for i in range(20)] + [(200, base[0][:9]), (200, base[6][10:24]), (201, base[0][:6] + base[3][:6]), (202, None), (203, ""), (204, "GGGGGGGGGGGG"), (204, "AAAAA")]
    return reads, transcripts


def _brute(reads, transcripts, union):
    kmers = lambda rows, key: {s[i: i + K] for x, s in rows if x == key and s for i in range(len(s) - K + 1)}
    index = {t: kmers(transcripts, t) for t, _ in transcripts}
    known, out = set().union(*index.values()), {}
    for read in {x for x, _ in reads}:
        if has := kmers(reads, read) & known:
            out[read] = sorted(t for t, x in index.items() if (has & x if union else has <= x))
    return out


@pytest.mark.parametrize("union", [False, True])
@pytest.mark.parametrize("most", [0, 200_000])
def test_classes_by_brute_force(spark, tmp_path, union, most):
    reads, transcripts = _made()
    of, sets = quant.pseudoalign(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(transcripts, "tx_id long, seq string"), K, str(tmp_path / "x"), union, most)
    want = _brute(reads, transcripts, union)
    got = of.join(sets, "ec_id").collect()
    assert len(got) == len(want) and {r.read_id: list(r.ec) for r in got} == want
    assert sets.count() == len({tuple(x) for x in want.values()})
    counted = {tuple(r.ec): r.n for r in quant.set_counts(of, sets).collect()}
    assert counted == {e: [tuple(x) for x in want.values()].count(e) for e in map(tuple, want.values()) if e}


def test_copies_add_no_work(spark, tmp_path):
    """Two or two hundred copies of transcripts and reads: the index and the sets worked on are as many."""
    sizes = []
    for n in (2, 200):
        t = spark.createDataFrame([(i, "ACGTTGCAAGGT" + "ACGT"[i % 4] * 5) for i in range(4 * n)], "tx_id long, seq string")
        r = spark.createDataFrame([(i, "ACGTTGCAAGG"[i % 3:]) for i in range(3 * n)], "read_id long, seq string")
        of, sets = quant.pseudoalign(r, t, K, str(tmp_path / str(n)))
        assert of.count() == 3 * n and [len(x.ec) for x in sets.collect()] == [4 * n]
        sizes.append([spark.read.parquet(str(tmp_path / str(n) / x)).count() for x in ("transcripts", "index", "sets", "whole")])
    assert sizes[0] == sizes[1] and sizes[0][0] == 4


def test_chains_of_copies(spark, tmp_path):
    """Chains between classes, written out, are those between all rows; copies add members, not chains."""
    from strandframe.operators import kmers
    from strandframe.plans.reads import reads, transcripts

    sf = "/root/testdata/sf0.001"
    q, t = reads(spark, sf).limit(300), transcripts(spark, sf).where("tx_id < 150")
    t = t.union(t.selectExpr("tx_id + 1000", "seq", "gene")).union(t.where("tx_id < 30").selectExpr("tx_id + 2000", "seq", "gene")).union(t.where("tx_id = 4")).union(t.where("tx_id = 5").selectExpr("6L", "seq", "gene"))
    q = q.union(q.where("read_id < 40").selectExpr("read_id + 50000", "header", "seq", "qual")).union(q.where("read_id = 7")).union(q.where("read_id = 9").selectExpr("8L", "header", "seq", "qual")).union(q.where("read_id = 1").selectExpr("read_id", "header", "null", "qual"))
    q.write.parquet(str(tmp_path / "q"))
    q = spark.read.parquet(str(tmp_path / "q"))
    index = kmers.minimizers(t, 7, 5, "tx_id")
    want = sorted(map(tuple, kmers.chains(kmers.seeds(kmers.minimizers(q, 7, 5), index), 7).collect()))
    got = kmers.class_chains(q, t, 7, 5, str(tmp_path / "x")).cache()
    assert want and sorted(map(tuple, kmers.expanded(got).collect())) == want
    assert got.where("kind = 'chain'").count() * 3 < len(want) * 2
    for kind, key, rows in (("read", "read_id", q), ("target", "tx_id", t)):
        assert sorted(r[0] for r in got.where(f"kind = '{kind}'").select(key).collect()) == sorted(r[0] for r in rows.select(key).distinct().collect())
    assert kmers.occurrence_cutoff(spark.read.parquet(str(tmp_path / "x/index"))) == kmers.occurrence_cutoff(index)
