"""Barcode chemistries: where barcode, molecular identifier and sequence are in the reads of a set of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, then barcode, identifier and sequence as file[start:stop) parts; stop 0 is the end of the read.
CHEMISTRIES = """
10XV2      0[0:16)                          0[16:26)  1[0:0)
10XV3      0[0:16)                          0[16:28)  1[0:0)
PARSEV3    1[10:18)+1[30:38)+1[50:58)       1[0:10)   0[0:0)
MATQSEQ    0[0:8)                           -         0[8:0)
PETRISEQ   0[7:14)+0[29:36)+0[50:58)        0[0:7)    1[0:17)
VISIUM     0[0:16)                          0[16:28)  1[0:0)
10XV1      0[0:14)                          1[0:10)   2[0:0)
SURECELL   0[0:6)+0[21:27)+0[42:48)         0[51:59)  1[0:0)
DROPSEQ    0[0:12)                          0[12:20)  1[0:0)
INDROPSV1  0[0:11)+0[30:38)                 0[42:48)  1[0:0)
INDROPSV2  1[0:11)+1[30:38)                 1[42:48)  0[0:0)
INDROPSV3  0[0:8)+1[0:8)                    1[8:14)   2[0:0)
CELSEQ     0[0:8)                           0[8:12)   1[0:0)
CELSEQ2    0[6:12)                          0[0:6)    1[0:0)
SPLIT-SEQ  1[10:18)+1[48:56)+1[78:86)       1[0:10)   0[0:0)
STORM-SEQ  -                                1[0:8)    0[0:0)+1[14:0)
SCRBSEQ    0[0:6)                           0[6:16)   1[0:0)
SMARTSEQ3  0[0:0)+1[0:0)                    2[0:19)   2[22:0)+3[0:0)
SMARTSEQ2  0[0:0)+1[0:0)                    -         2[0:0)
BDWTA      0[0:9)+0[21:30)+0[43:52)         0[52:60)  1[0:0)
VASA-SEQ   0[6:14)                          0[0:6)    0[14:0)
"""


def layout(name: str) -> list[list[tuple[int, int, int]]]:
    """Barcode, identifier and sequence parts as (file, start, stop); a name, or bc:umi:seq of file,start,stop triples."""
    if ":" in name:
        numbers = [[int(x) for x in part.split(",")] for part in name.split(":")]
        return [[tuple(p[i: i + 3]) for i in range(0, len(p), 3)] if p[0] >= 0 else [] for p in numbers]
    for line in CHEMISTRIES.split("\n"):
        if line.split()[:1] == [name.upper()]:
            cells = line.split()[1:]
            return [[] if c == "-" else [(int(p[0]), *map(int, p[2:-1].split(":"))) for p in c.split("+")] for c in cells]
    raise ValueError(f"no chemistry {name!r}")


def extract(name: str, reads: list[Column]) -> list[Column]:
    """barcode, umi and sequence columns from the reads of the files."""
    def piece(file: int, start: int, stop: int) -> Column:
        return F.substring(reads[file], F.lit(start + 1), F.lit(stop - start) if stop else F.length(reads[file]))

    return [F.concat(*[piece(*p) for p in part]) if part else F.lit("") for part in layout(name)]
