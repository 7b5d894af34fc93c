"""Python data sources of read files: ``fastq`` (and FASTA) and ``encoded`` in modes 0 to 3; and their writers."""

from __future__ import annotations

import bz2
import glob
import gzip
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import headers
from ..functions.codec import BASES, CODES, Coding, encode_frame, inverse_lut

READS = "read_id long, header string, seq string, qual string, file string"
ENCODED = "read_id long, header string, codes binary, file string, mode int, gray array<int>, structure string, second_head boolean"


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


def opened(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else bz2.open(path, "rb") if path.endswith(".bz2") else open(path, "rb")


def fastq_records(lines: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, bytes, int]]:
    """(header, sequence, quality, bytes read so far) of each whole record; sequence and quality may take several lines.

    A line of a quality may begin with @ or +: qualities end by length. An unfinished last record is left out; a
    quality that is too long is cut.
    """
    read = 0
    header, seq, qual, state = b"", b"", b"", "between"
    for line in lines:
        read += len(line)
        line = line.rstrip(b"\r\n")
        if state == "between":
            if line.startswith(b"@"):
                header, seq, qual, state = line, b"", b"", "sequence"
        elif state == "sequence":
            if line.startswith(b"+"):
                state = "quality"
            else:
                seq += line
        else:
            qual += line
            if len(qual) >= len(seq):
                yield header, seq, qual[: len(seq)], read
                state = "between"


def fasta_records(lines: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    header, seq = None, []
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line.startswith(b">"):
            if header is not None:
                yield header, b"".join(seq)
            header, seq = line, []
        elif header is not None:
            seq.append(line)
    if header is not None:
        yield header, b"".join(seq)


class _Reader(DataSourceReader):
    """One partition per file, or per span of an uncompressed FASTQ file of more than ``chunk`` bytes.

    Planning reads a large file once to find record starts and number the records, as a line that begins with @ may
    be a quality.
    """

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.paths = sorted(p for x in path.split(",") for p in (glob.glob(os.path.join(x, "*")) if os.path.isdir(x) else glob.glob(x)) if not os.path.basename(p).startswith(("_", ".")))
        if not self.paths:
            raise FileNotFoundError(path)
        self.chunk = int(options.get("chunk", 64 << 20))

    def partitions(self) -> list[Span]:
        out, n = [], 0
        for path in self.paths:
            if len(self.paths) == 1 and (path.endswith((".gz", ".bz2")) or os.path.getsize(path) <= self.chunk):
                out.append(Span(path, 0, -1, 0))
                continue
            with opened(path) as f:
                if path.removesuffix(".gz").removesuffix(".bz2").endswith((".fa", ".fasta", ".fna")):
                    out.append(Span(path, 0, -1, n))
                    n += sum(1 for _ in fasta_records(f))
                    continue
                start, first, whole = 0, n, path.endswith((".gz", ".bz2"))
                for *_, read in fastq_records(f):
                    n += 1
                    if not whole and read - start >= self.chunk:
                        out.append(Span(path, start, read, first))
                        start, first = read, n
                out.append(Span(path, start, -1, first))
        return out

    def read(self, part: Span) -> Iterator[tuple]:
        text = lambda b: b.decode("latin-1")
        with opened(part.path) as f:
            f.seek(part.start)
            if part.path.removesuffix(".gz").removesuffix(".bz2").endswith((".fa", ".fasta", ".fna")):
                for i, (h, s) in enumerate(fasta_records(f)):
                    yield part.first + i, text(h), text(s), None, part.path
                return
            for i, (h, s, q, read) in enumerate(fastq_records(f)):
                yield part.first + i, text(h), text(s), text(q), part.path
                if part.end >= 0 and part.start + read >= part.end:
                    return


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path): a file, folder or pattern, several by commas; .gz and .bz2; FASTA by extension."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


# The keys of an encoded file's preamble, in order.
KEYS = ("MODE", "SEQ-TYPE", "ACCESSION", "INSTRUMENT", "SAMPLE-ID", "RUN-NUMBER", "RUN-DATE(YYYYMMDD)", "RUN-START-TIME", "FLOW-CELL", "GRAY_VALS", "PHRED-ALPHABET", "LENGTH", "SECOND_HEAD", "SAFE_MODE", "PAIRED-END",
        "PAIRED-END-SAME-FILE", "STRUCTURE")


def preamble(mode: int, coding: Coding = Coding(), **fields: str) -> bytes:
    values = {"MODE": str(mode), "GRAY_VALS": ",".join(map(str, coding.codes))} | fields
    return "".join(f"#{k}={values.get(k, '')}\n" for k in KEYS if k != "PHRED-ALPHABET" or k in values).encode()


def read_preamble(data: bytes) -> tuple[dict[str, str], int]:
    """Fields and the place where the body begins: at the first line that is none of the known keys."""
    fields, at = {}, 0
    while data[at: at + 1] == b"#":
        end = data.find(b"\n", at)
        line = data[at: end if end >= 0 else len(data)].decode("latin-1")[1:]
        key, sep, value = line.partition("=")
        if key not in KEYS or not sep:
            if fields or "=" in line:
                break
            key, value = "SRA", line
        fields[key] = value
        at = end + 1 if end >= 0 else len(data)
    return fields, at


def encoded_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, numbers or sequence and quality) of a file's body, framed by lines, never by a line's first byte."""
    fields, at = read_preamble(data)
    mode = int(fields.get("MODE", "2"))
    lines = data[at:].split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    if mode == 3:
        for i, line in enumerate(x for x in lines if x):
            yield f"@seq{i}".encode(), line
    elif mode in (1, 2):
        for i in range(0, len(lines) - 1, 2):
            yield lines[i].rstrip(b"\xff"), lines[i + 1]
    else:
        for h, s, q, _ in fastq_records(x + b"\n" for x in lines):
            yield h, s + b"\n" + q


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: any that pyarrow knows by its scheme, else this machine's."""
    return pafs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][\w+.-]*:", uri) else (pafs.LocalFileSystem(), uri)


_ORDINAL = re.compile(r"-(\d+)\.enc$")


class _EncodedReader(DataSourceReader):
    """A partition per file; the files of a folder that ``write_encoded`` wrote have their first read number in their name."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Span]:
        fs, path = store(self.path)
        folder = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            found = [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File]
        else:
            found = glob.glob(path) if isinstance(fs, pafs.LocalFileSystem) else [path]
        found = sorted(x for x in found if not x.endswith("_headers.txt") and not os.path.basename(x).startswith(("_", ".")))
        return [Span(folder + p, 0, -1, int(m[1]) if (m := _ORDINAL.search(p)) else i << 40) for i, p in enumerate(found)]

    def read(self, part: Span) -> Iterator[tuple]:
        fs, path = store(part.path)
        with fs.open_input_stream(path) as f:
            data = f.read()
        fields, _ = read_preamble(data)
        mode = int(fields.get("MODE") or 2)
        heads: list[bytes] = []
        if mode == 3 and fs.get_file_info(f"{path}_headers.txt").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}_headers.txt") as f:
                heads = f.read().split(b"\n")
        gray = [int(x) for x in (fields.get("GRAY_VALS") or ",".join(map(str, CODES))).split(",")]
        accession = fields.get("ACCESSION") or fields.get("SRA")
        for i, (h, c) in enumerate(encoded_records(data)):
            if mode == 3:  # the side-car's line, else a number after the accession, else after seq
                h = heads[i] if i < len(heads) and heads[i] else f"@{accession}.{part.first + i}".encode() if accession else f"@seq{part.first + i}".encode()
            yield part.first + i, h.decode("latin-1"), c, part.path, mode, gray, fields.get("STRUCTURE", ""), fields.get("SECOND_HEAD") == "y"


class EncodedSource(DataSource):
    """spark.read.format("encoded").load(path): (read_id, header, codes, file) of encoded files, a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "encoded"

    def schema(self) -> str:
        return ENCODED

    def reader(self, schema) -> DataSourceReader:
        return _EncodedReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(EncodedSource)


# The preamble fields that the common groups of a layout fill.
_FILLS = {"illumina": {"INSTRUMENT": 1, "RUN-NUMBER": 2, "FLOW-CELL": 3}, "old_illumina": {"INSTRUMENT": 1}, "sra": {"ACCESSION": 1}, "ont_sra": {"ACCESSION": 1}, "pacbio_hifi": {"movie": 1}, "pacbio_subread": {"movie": 1},
          "pacbio_clr": {"movie": 1}, "illumina_sra": {"ACCESSION": 1, "INSTRUMENT": 3, "RUN-NUMBER": 4, "FLOW-CELL": 5}, "pacbio_hifi_sra": {"ACCESSION": 1, "movie": 3}, "pacbio_clr_sra": {"ACCESSION": 1, "movie": 3}}


def vendor_fields(header: str, vendor: str) -> dict[str, str]:
    """Preamble fields of a file from one of its headers; a movie's name is an instrument, a date and a time."""
    m = re.match(headers.VENDORS[vendor].pattern, header.removeprefix("@"))
    found = {k: m[i] for k, i in _FILLS.get(vendor, {}).items()} if m else {}
    movie = found.pop("movie", "").split("_")
    if movie[0]:
        found["INSTRUMENT"] = movie[0]
        found |= {k: x for k, x in zip(("RUN-DATE(YYYYMMDD)", "RUN-START-TIME"), movie[1:], strict=False) if len(x) == 6}
    return found | {"SEQ-TYPE": vendor}


def _writing(folder: str, mode: int, first_lines: bytes):
    """A file per task, under another name first, so lost or repeated tasks leave no half file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        own, name = f"{path}/_writing-{uuid.uuid4().hex}", f"{path}/_part-{part:06d}"
        heads = fs.open_output_stream(f"{own}_headers.txt") if mode == 3 else None
        with fs.open_output_stream(own) as out:
            out.write(first_lines)
            for batch in batches:
                for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    h = (h or "").encode("latin-1", "replace") + b"\n"
                    if heads:
                        heads.write(h)
                    out.write(c + b"\n" if heads else h + c + b"\n")
                    n += 1
        if heads:
            heads.close()
            fs.move(f"{own}_headers.txt", f"{name}_headers.txt")
        fs.move(own, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]}, pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    return run


def write_encoded(reads: DataFrame, path: str, mode: int = 2, coding: Coding = Coding(), vendor: str | None = None, second_head: bool = False, files: int | None = None) -> int:
    """Write ``reads`` as a folder of encoded files, in order of read_id, by executors; returns the number of reads.

    mode 0: headers, bases and qualities; 1: headers and numbers; 2: as 1, and if ``vendor`` is given and all headers are
    of one structure of it and rebuild exactly, only the parts of headers that vary, with STRUCTURE in the preamble; 3:
    numbers, with headers in <file>_headers.txt. A file is named after its first read's place.
    """
    rows, fields = reads, {"SECOND_HEAD": "y" if second_head else ""}
    if vendor:
        if first := reads.where("header is not null").first():
            fields |= vendor_fields(first["header"], vendor)
        if mode == 2:
            made = headers.compressed(reads, vendor)
            same = made.agg(F.min("structure").alias("a"), F.max("structure").alias("b"), F.min(F.col("exact") & ~F.exists("parts", lambda p: p.contains(":") | p.contains("/"))).alias("exact")).first()
            if same["exact"] and same["a"] == same["b"]:
                rows = made.withColumn("header", F.concat(F.lit("@"), F.array_join("parts", ":")))
                fields["STRUCTURE"] = same["a"]
    dealt = rows.select("read_id", "header", "seq", "qual")
    dealt = dealt.repartitionByRange(files, "read_id") if files else dealt.repartitionByRange("read_id")
    dealt = dealt.sortWithinPartitions("read_id").select("header", "seq", "qual")
    if mode == 0:
        dealt = dealt.select("header", F.encode(F.concat_ws("\n", "seq", F.lit("+"), "qual"), "ISO-8859-1").alias("codes"))
    else:
        dealt = encode_frame(dealt, coding)
    counts = sorted((r["part"], r["n"]) for r in dealt.mapInArrow(_writing(path, mode, preamble(mode, coding, **fields)), "part int, n long").collect())  # a row per file
    fs, folder = store(path)
    at = 0
    for part, n in counts:
        for end in ("", "_headers.txt") if mode == 3 else ("",):
            fs.move(f"{folder}/_part-{part:06d}", f"{folder}/reads-{at:012d}.enc") if not end else fs.move(f"{folder}/_part-{part:06d}{end}", f"{folder}/reads-{at:012d}.enc{end}")
        at += n
    return at


def decoded(encoded: DataFrame, codes: tuple[int, ...] | None = None, lut: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """(read_id, header, seq, qual) of encoded rows, by each file's own codes and structure: byte translation tables on whole values.

    codes: in place of the file's; lut: the quality table of a custom coding.
    """
    back = inverse_lut(lut) if lut else list(range(64))

    def tables(gray: tuple[int, ...]) -> tuple[bytes, bytes]:
        value = [10 if v == 255 else v for v in range(256)]
        low = [max((c for c in gray if c <= v), default=gray[0]) for v in value]
        return bytes(ord(BASES[gray.index(x)]) for x in low), bytes(33 + min(93, back[min(63 if lut else 62, max(0, v - x))]) for v, x in zip(value, low, strict=True))

    def run(batches):
        known: dict[tuple[int, ...], tuple[bytes, bytes]] = {}
        for b in batches:
            seqs, quals = [], []
            for x, gray, mode in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if mode == 0:
                    seq, _, qual = (x or b"").partition(b"\n")
                else:
                    gray = tuple(codes or gray or CODES)
                    if gray not in known:
                        known[gray] = tables(gray)
                    seq, qual = ((x or b"").translate(t) for t in known[gray])
                seqs.append(seq.decode("latin-1"))
                quals.append(qual.decode("latin-1"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seqs, pa.string()), pa.array(quals, pa.string())], ["read_id", "header", "seq", "qual"])

    have = lambda c, kind: F.col(c) if c in encoded.columns else F.lit(None).cast(kind)
    header = F.col("header")
    if "structure" in encoded.columns:
        rebuilt = F.concat(F.lit("@"), headers.rebuild(F.col("structure"), F.split(F.substring("header", 2, 1 << 30), ":")))
        header = F.when((F.col("structure") != "") & (F.col("mode") == 2), rebuilt).otherwise(header)
    return encoded.select("read_id", header.alias("header"), "codes", have("gray", "array<int>"), have("mode", "int")).mapInArrow(run, "read_id long, header string, seq string, qual string")


def fastq_text(reads: DataFrame, second_header: bool = False) -> DataFrame:
    """(value): the four lines of each record, for ``write.text``."""
    plus = F.concat(F.lit("+"), F.regexp_replace("header", "^@", "")) if second_header else F.lit("+")
    return reads.select(F.concat_ws("\n", "header", "seq", plus, "qual").alias("value"))
