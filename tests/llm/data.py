"""A small table with every odd case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, band string, g string, h string, k string, size string, label int, term string"


def rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice(("ba", "ko", "ti", "re", "lu", "sha", "é")) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [prose(rnd.randint(15, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].upper()]  # exact copies, and one in another case
    for i in range(6):  # near copies
        w = texts[2 + i % 2].split()
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(60)
    texts += [prose(10) + " " + passage + "\n" + prose(9), passage + " " + prose(30), prose(5) + "\t" + passage]
    texts += [None, "", " \n\t ", "one", "two words", "line a\nline a\nline a\n\n  b", prose(3000), "x" * 5000, "a  b\u00a0c d\x1ce <|endoftext|> 's it's"]
    texts += ["same words here " * 30]
    out = [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "s10")[min(i % 9, 3)], len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], (None, texts[6], "en", "s1", 3), (None, None, None, None, None)]
    return [(*r, 7, "b", "g", "h", "k", "z", 1, "t") for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text):
    return WORD.findall(text or "")
