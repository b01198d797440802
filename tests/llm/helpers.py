"""Small corpora with the cases that every operator must stand, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "tö", "vé") for b in ("ran", "bel", "dor", "fis", "gum", "hap", "jix", "mon")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(_VOCABULARY) + rng.choice(("", "", "", ",", ".")) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """(doc_id, text): originals, exact and near copies, shared passages, nulls, empty, white and very long texts, ties."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(3, 220)) for _ in range(40)]
    passage = prose(rng, 60)
    for i in range(6):
        words = texts[i].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "änderung"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[4], texts[5].upper()]
    texts += [prose(rng, 30) + "\n" + passage + "\t" + prose(rng, 20) for _ in range(4)]
    texts += [None, "", "   \n\t ", "one", "one two", "one two", "a\x0bb\x0cc\rd", "  wide space", prose(rng, 30_000)]
    return list(enumerate(texts))


def frame(spark, rows, extra: bool = True):
    """documents with a null doc_id, and extra columns whose names clash with those that operators make."""
    schema = "doc_id long, text string" + (", component_id string, kept string, score string, k int, start string, hash long, component double, key string" if extra else "")
    return spark.createDataFrame([(d, t, *(["x", None, "y", 1, "z", 2, 0.5, "q"] if extra else [])) for d, t in rows], schema)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
