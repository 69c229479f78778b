"""Awkward rows that every operator has to take, and plain counterparts."""

import hashlib
import random

CLASHES = ("key", "h", "k", "m", "c", "s", "e", "n", "w", "words", "text_hash", "size", "rank", "spans", "slot", "part")


def words_of(text):
    return (text or "").encode().split()


def awkward(spark, rows=None, clashes=CLASHES):
    """doc_id, text, lang, source, n_chars and columns whose names operators use inside."""
    base = "a tale of two words told again and again, " * 12
    if rows is None:
        rows = [
            (1, "short text", "src0"), (2, None, "src0"), (3, "", None), (None, base, "src1"), (4, base, None),
            (4, base, None), (5, base + "x", "src1"), (6, "\n \t\r\x0b\x0c", "src0"), (7, "one", "src2"),
            (8, " ".join(f"w{i % 977}" for i in range(30_000)), "src2"), (9, "é ü 日本 😀 #$% <|end|> 'tis", "src3"),
            (None, None, None), (10, "a\nb\n\na\nb", "src3"), (11, "ONE", "src2"),
        ]
    data = [(i, t, "en", s, len(t or ""), *[-7] * len(clashes)) for i, t, s in rows]
    extra = "".join(f", `{c}` int" for c in clashes)
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long{extra}")


def empty(spark):
    return awkward(spark, [])


def corpus(seed=3, n=120):
    """Texts with copies, edits, shared passages and many repeated words."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("a", "e", "io", "un", "ost")]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 150))]
            if kind > 0.8:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage[: rng.randrange(30, 61)]
            texts.append(" ".join(w))
    return texts


def sha(parts):
    return hashlib.sha256(b" ".join(parts)).hexdigest()
