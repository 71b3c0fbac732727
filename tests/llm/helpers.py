"""Plain-Python versions of what operators count, and rows that every operator must take."""

import hashlib
import random
import re
import zlib

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower().decode()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def prose(seed, words=60, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{min(int(r.paretovariate(0.8)), vocabulary)}" for _ in range(words))


#: Rows that every operator must take: null and empty columns, blanks only, repeated rows, ties, one very long text, odd characters.
def awkward():
    long = prose(99, 30_000, 50_000)
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(12)]
    rows += [(20, None, "en", "s1"), (21, "", None, None), (22, " \n\t ", "fr", None), (None, prose(3), "en", "s0"), (None, None, None, None)]
    rows += [(5, prose(5), "en", "s2"), (30, prose(5), "en", "s2"), (31, prose(5) + " extra", "de", "s2"), (32, prose(5).upper(), "de", "s1")]
    rows += [(40, long, "en", "s0"), (41, "é ü 日本   x", "fr", "s0"), (42, "one", "en", "s0"), (43, "###$$$ %%% " * 30, "en", "s1"), (43, "other text of one id", "en", "s1")]
    return rows
