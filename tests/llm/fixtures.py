"""Small inputs: the smallest documents table with odd rows, and brute-force helpers."""

import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, h long, `a.b` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^ \t-\r]+")

ODD = [None, "", "   \n", "one", "one two three four", "A b C d E", "a B c D e", "x" * 3000, "word " * 900, "é ü 日本語 🎉", "1234 !!", "line\n" * 300, "tab\tand\x0bvt", "word " * 900]


def rows(n=60):
    t = pq.read_table(f"{SF}/documents.parquet").slice(0, n).to_pylist()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y", 7, 1) for r in t]
    out += [(100_000 + i, text, None if i % 3 else "en", None if i % 2 else "src0", None, None, None, None, None) for i, text in enumerate(ODD)]
    return out


def docs(spark, n=60):
    return spark.createDataFrame(rows(n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts
