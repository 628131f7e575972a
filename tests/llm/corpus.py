"""A small corpus with every awkward kind of row, and words by the contracts' definition."""

import random
import re

BREAKS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, line long, chunk int, component long"
#: Names that the operators use or might.
CLASHING = ("_key", "_gone", "_kept", "_row", "_crc", "_bytes", "_hex", "_spans", "_candidates", "row", "own", "kept", "gone", "id", "print", "hex", "spans", "host", "node", "changed", "a column")
SCHEMA += "".join(f", `{c}` string" for c in CLASHING)


def words(text):
    return BREAKS.findall(text or "")


def documents(seed=0, n=60):
    """(doc_id, text): prose, copies, near copies, shared passages, null and empty texts, one very long text, repeated rows, a null id."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "naïve", "x"] + ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda k: "".join(w + rng.choice([" ", " ", " ", "\n", ", ", ".\t"]) for w in rng.choices(vocabulary, k=k))
    passage = prose(60)
    texts = [prose(rng.randint(1, 150)) for _ in range(n)]
    for k in range(0, n, 5):
        texts[k] += passage
    base = prose(200)
    near = []
    for _ in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        near.append(" ".join(w))
    texts += [base] * 4 + near + [texts[3], texts[3].upper(), None, "", "\n\n", " ", "one", "one", "two words", "a b c", "A b C", "only \u2003 wide\u00a0space", prose(6000), "🙂 é\x00 z"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], (rows[1][0], "other text for one id"), (None, "no id at all " + passage)]


def frame(spark, rows):
    """The rows with all columns of documents and others whose names clash with what the operators make."""
    full = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 7 else None, None if t is None else len(t), "w", 1, 2, 3, *CLASHING) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
