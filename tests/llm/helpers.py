import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=""):
    """documents from (doc_id, text) pairs; ``extra`` adds clashing columns of nulls."""
    df = spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    for c in extra.split():
        df = df.selectExpr("*", f"CAST(NULL AS string) AS {c}")
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared passages, odd texts and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120), 5000)) for i in range(60)]
    base = prose(rng, 150, 5000)
    passage = prose(rng, 40, 5000)
    for i in range(60, 90):  # near copies of base
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    for i in range(90, 110):  # a shared passage, its edges cut
        a, z = rng.randint(0, 10), rng.randint(25, 40)
        rows.append((i, f"{prose(rng, 15, 5000)} {' '.join(passage.split()[a:z])} {prose(rng, 15, 5000)}"))
    rows += [(110, None), (111, ""), (112, " \n\t "), (113, "one"), (114, "one"), (115, "one two three"), (116, "a\x0bb\x0cc  d\r\ne"),
             (117, "ONE"), (118, "rep " * 300), (119, "rep " * 290), (120, rows[0][1]), (121, rows[0][1]), (121, rows[0][1]), (122, "\u00a0é\u2003ß"),
             (123, prose(rng, 6000, 9000))]
    rng.shuffle(rows)
    return rows
