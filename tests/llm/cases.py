"""Texts and brute-force versions that the operator tests share."""

import re
import zlib

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def rows(sf, columns="doc_id, text, lang"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


ODD_TEXTS = [
    None, "", " ", "\n\n", "\t \r\n\x0b\x0c", "a", "A", "é É ß", "日本語 の テキスト", "😀 😀 😀 😀", "12345 !!! ---",
    "a a a a a a a a a a a a a", "The same line here\nThe same line here\n the SAME line here \nother", "▁▁ a▁b", "<s>x</s> <unk>\x00",
    "word " * 3000, "x" * 50_000, "ab cd　ef", "line one of the text\n" * 400,
]

# Names that the operators use inside, and names they add.
CLASHES = ["id", "fp", "low", "root", "cell", "label", "score", "lang_pred", "kept_text", "n_lines", "ids", "decoded", "h1", "owner", "_doc", "batch"]


def odd_frame(spark):
    """Odd texts with null and repeated ids, a row twice, and columns with clashing names."""
    data = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    data += [data[5], data[11], (None, "no id at all, just text", "en", None, None), (None, None, None, None, None), (7, "another text of seven", "fr", "s", 1)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        if name != "_doc":
            frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame


def empty_frame(spark):
    return odd_frame(spark).where("false")
