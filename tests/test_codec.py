import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import chemistry, codec, headers
from strandframe.operators import qc
from strandframe.sources import fastq


def test_every_base_and_quality_round_trips(spark):
    rows = [(b, chr(33 + q)) for b in "ACGT" for q in range(63)]
    df = spark.createDataFrame([("".join(b for b, _ in rows), "".join(q for _, q in rows))], "seq string, qual string")
    n = codec.encode(F.col("seq"), F.col("qual"))
    r = df.select(codec.decode_seq(n).alias("s"), codec.decode_qual(n).alias("q"), "seq", "qual", n.alias("n")).first()
    assert (r.s, r.q) == (r.seq, r.qual)
    assert 10 not in r.n and 255 in r.n


def test_n_keeps_three_steps_and_unknown_letters_are_n(spark):
    df = spark.createDataFrame([("NNNax", "!@_II")], "seq string, qual string")
    assert df.select(codec.encode(F.col("seq"), F.col("qual")).alias("n")).first().n == [0, 1, 2, 1, 1]


def test_codings_are_checked():
    with pytest.raises(ValueError):
        codec.Coding(codes=(0, 129, 66, 3, 192))
    with pytest.raises(ValueError, match="line 2"):
        codec.parse_lut("1 5\n3 63\n")
    assert codec.parse_lut("# x\n2 7 # y\n") == ((2, 7),)
    assert codec.interpolated_lut([(1, 2), (9, 6)])[:8] == [1, 1, 1, 3, 5, 7, 9, 9]


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_encoded_files_round_trip(spark, tmp_path, mode):
    fastq.register(spark)
    random.seed(mode)
    reads = [(i, f"@r{i} x", "".join(random.choice("ACGT") for _ in range(n)), "".join(chr(33 + random.randrange(63)) for _ in range(n))) for i, n in enumerate([1, 5, 40, 200])]
    df = spark.createDataFrame([*reads, (4, "@q", "AAAA", "(A@+")], "read_id long, header string, seq string, qual string")
    path = str(tmp_path / "x.enc")
    fastq.write_encoded(df, path, mode)
    got = spark.read.format("encoded").load(path)
    if mode == 0:
        assert [bytes(r.codes).decode().split("\n")[0] for r in got.orderBy("read_id").collect()] == [r.seq for r in df.orderBy("read_id").collect()]
        return
    rows = fastq.decoded(got).orderBy("read_id").collect()
    assert [(r.seq, r.qual) for r in rows] == [(r.seq, r.qual) for r in df.orderBy("read_id").collect()]
    if mode < 3:
        assert [r.header for r in rows] == [r.header for r in df.orderBy("read_id").collect()]


def test_fastq_source(spark, tmp_path):
    fastq.register(spark)
    p = tmp_path / "a.fastq"
    p.write_bytes(b"@a\nACG\nTAC\n+\n@II\n+II\n\n@b\r\nAC\r\n+b\r\n@@\r\n@cut\nACGT\n+\nII")
    rows = spark.read.format("fastq").load(str(p)).orderBy("read_id").collect()
    assert [(r.header, r.seq, r.qual) for r in rows] == [("@a", "ACGTAC", "@II+II"), ("@b", "AC", "@@")]
    big = tmp_path / "b.fastq"
    big.write_bytes(b"".join(b"@r%d\nACGTACGT\n+\n@@@@IIII\n" % i for i in range(500)))
    df = spark.read.format("fastq").option("chunk", 3000).load(str(big))
    assert df.rdd.getNumPartitions() > 1
    assert [r.header for r in df.orderBy("read_id").collect()] == [f"@r{i}" for i in range(500)]
    (tmp_path / "c.fa").write_bytes(b">x\nAC\nGT\n>y\nTT\n")
    assert [(r.header, r.seq) for r in spark.read.format("fastq").load(str(tmp_path / "c.fa")).orderBy("read_id").collect()] == [(">x", "ACGT"), (">y", "TT")]


def test_headers_that_do_not_rebuild_stay_whole(spark):
    df = spark.createDataFrame([("@m64011_190830_220126/1/ccs",), ("@m64011_190830_220126/1/ccs rq=0.9",), ("@odd",)], "header string")
    rows = headers.compressed(df, "pacbio_hifi").collect()
    assert [r.structure for r in rows] == ["m64011_190830_220126/{1}/ccs", "", ""]
    assert rows[1].parts == ["m64011_190830_220126/1/ccs rq=0.9"]


def test_format_length(spark):
    cases = {0: "0 bp", 100: "100 bp", 1000: "1 kbp", 1250: "1.2 kbp", 1_000_000: "1 Mbp", 1_999_999: "1.9 Mbp", 2_500_000_000: "2.5 Gbp"}
    df = spark.createDataFrame([(n,) for n in cases], "n long")
    assert {r.n: r.f for r in df.select("n", qc.format_length(F.col("n")).alias("f")).collect()} == cases


def test_bins_and_layouts():
    assert qc.bins(75)[-1] == (75, 75)
    for n in (76, 100, 151, 1000, 20000):
        b = qc.bins(n)
        assert b[0] == (1, 1) and b[-1][1] == n and all(x[1] + 1 == y[0] for x, y in zip(b, b[1:])) and len(b) <= 76
    ends = lambda n: [b for _, b in qc.bins(n, exponential=True)]
    assert ends(75) == list(range(1, 76)) and ends(100) == [*range(1, 10), *range(14, 100, 5), 100]
    assert qc.bins(250, exponential=True)[17] == (50, 59)
    assert qc.bins(301, exponential=True)[-1] == (300, 301) and qc.bins(2001, exponential=True)[-1] == (2000, 2001)
    assert chemistry.layout("10XV2") == [[(0, 0, 16)], [(0, 16, 26)], [(1, 0, 0)]]
    assert chemistry.layout("0,0,2:0,2,6:1,0,0") == [[(0, 0, 2)], [(0, 2, 6)], [(1, 0, 0)]]


def test_stream(spark, tmp_path):
    from strandframe.streaming.encode import encode_stream

    spark.createDataFrame([(1, "@a", "ACGT", "IIII")], "read_id long, header string, seq string, qual string").write.parquet(str(tmp_path / "in"))
    encode_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first().codes) == bytes([43, 106, 169, 232])


def test_formulas(spark):
    from pyspark.sql import functions as F

    from strandframe.functions import scalars

    one = spark.range(1)
    value = lambda text, x: one.select(scalars.formula(text, F.lit(x)).alias("y")).first().y
    assert value("f(x)= -x^2 + 2*3", 3) == -3 and value("2**3**2 / (x - 1)", 3) == 256 and abs(value("exp(ln(x)) + log10(100)", 5) - 7) < 1e-12
    for bad in ("x; drop", "__import__(x)", "x +", "(x", "y", "sin(x)", "x x"):
        with pytest.raises(ValueError):
            scalars.formula(bad, F.lit(1))


def test_length_intervals():
    assert qc.length_interval(0, 50) == (0, 1) and qc.length_interval(99, 251) == (95, 5) and qc.length_interval(0, 20_001) == (0, 500)


def test_gene_map_and_sorted_csv(spark, tmp_path):
    from strandframe.operators import etl

    (tmp_path / "map.tsv").write_text("#tx\tgene\nt1\tg1\textra\nt2\tg1\n")
    found = etl.read_gene_map(spark, str(tmp_path / "map.tsv"))
    assert sorted(map(tuple, found.collect())) == [("t1", "g1"), ("t2", "g1")]
    etl.write_sorted_csv(found, str(tmp_path / "out"), "tx")
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0].tx == "t1"


def test_bootstrap_settles(spark):
    from strandframe.operators import quant

    counts = spark.createDataFrame([([1], 60), ([1, 2], 40), ([2, 3], 10)], "ec array<int>, n long")
    lengths = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 5.0)], "tx int, eff_length double")
    whole = {r.tx: r.alpha for r in quant.em(spark, counts, lengths).collect()}
    assert abs(sum(whole.values()) - 110) < 1e-6
    samples = quant.bootstrap(spark, counts, lengths, 5).groupBy("sample").sum("alpha").collect()
    assert len(samples) == 5 and all(abs(r[1] - 110) < 1e-6 for r in samples)


def test_encoded_files_by_their_own_codes(spark, tmp_path):
    """Custom codes and table, headers of one structure reduced to their parts, of several kept whole, a file per task."""
    fastq.register(spark)
    rows = [(i, f"@M01368:85:FC1:1:{1101 + i % 3}:{i}:{i * 7} 1:N:0:ACGT", "ACGTN"[i % 4:] + "A", "I" * (6 - i % 4)) for i in range(50)]
    df = spark.createDataFrame(rows, "read_id long, header string, seq string, qual string")
    lut = tuple((q, 1 + q // 2) for q in range(1, 94))
    coding = codec.Coding(codes=(1, 10, 80, 150, 200), lut=lut)
    for name, table in (("plain", df), ("mixed", df.union(spark.createDataFrame([(99, "@other", "AC", "II")], df.schema)))):
        path = f"file://{tmp_path}/{name}"
        assert fastq.write_encoded(table, path, 2, coding, "illumina", files=3) == table.count()
        found = spark.read.format("encoded").load(path)
        assert found.select("file").distinct().count() == 3 and (found.first().structure != "") == (name == "plain")
        got = fastq.decoded(found, lut=lut).orderBy("read_id").collect()
        want = table.orderBy("read_id").collect()
        assert [(r.header, r.seq) for r in got] == [(r.header, r.seq) for r in want] and [r.read_id for r in got] == list(range(len(want)))
        assert {c for r in got for s, c in zip(r.seq, r.qual) if s != "N"} == {chr(33 + 41)}
    data = next(tmp_path.glob("plain/reads-000000000000.enc")).read_bytes()
    assert b"#INSTRUMENT=M01368\n#SAMPLE-ID=\n#RUN-NUMBER=85\n" in data and b"#FLOW-CELL=FC1\n#GRAY_VALS=1,10,80,150,200\n" in data
