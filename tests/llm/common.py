"""Small tables that hold the hard cases, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, size int, copy_no int, blk string, doc string"


def docs(spark, rows, langs=None):
    """Rows (id, text[, lang, source]) with further columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "k", 1, 2, "b", "d") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("th er on an re he in ed nd ha".split()) for _ in range(r.randint(1, 4))) for _ in range(words))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared passages, periodic ones, nulls, empties, and repeated rows."""
    r = random.Random(seed)
    out: list[tuple] = []
    passage = prose(999, 30)
    for i in range(n):
        kind = i % 10
        if kind < 4 or not out:
            text = prose(seed * 1000 + i, r.randint(1, 120))
        elif kind == 4:
            text = r.choice([t for _, t, *_ in out if t])
        elif kind == 5:
            words = r.choice([t for _, t, *_ in out if t]).split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 6:
            text = prose(i, 20) + " " + passage + " " + prose(i + 500, 20)
        elif kind == 7:
            text = "ab " * r.randint(1, 80)
        elif kind == 8:
            text = r.choice(["", None, " ", "\n\t", "é", "日本語 テキスト " * 12])
        else:
            text = "  " + r.choice([t for _, t, *_ in out if t]).replace(" ", "\t", 3)
        out.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "é", None])))
    out += [out[0], out[0], (None, prose(5, 40), "en", "a"), (None, prose(5, 40), "en", "a"), (7000, prose(77, 20_000), "en", "b")]
    return out


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


WORD = re.compile(r"[^\x20\x09-\x0D]+")
