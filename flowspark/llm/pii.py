"""Personal data by weak supervision, in DataFrame operations only.

Base spans are what four patterns match (email, ip, card, phone), checked by number of digits, Luhn sum and byte range.
The method adds spans. Candidates are broad: long tokens of letters and digits (kind ``secret``), digits alone or in
groups (kind ``number``: dates, versions and amounts too) and runs of capitalized words (kind ``name``). Labelers vote
on each - patterns, a checksum, gazetteers and contexts; yes, no or abstain -, expectation-maximisation over the counts of
vote patterns estimates how often each labeler says yes on true and on false candidates, and a logistic span classifier
is fitted to the posterior, on votes and on shapes that no labeler sees. Its threshold decides; base spans come first.

Votes and shapes have few values: however large the corpus, at most ``most_patterns()`` counted rows reach the driver,
in practice some hundreds; counts cover all documents. Matches leave the documents as rows of lengths, never with the
text.

Nulls: a null text has no spans. Null doc_ids are carried. Repeated rows are documents of their own. Other columns are
ignored. A corpus without candidates fits no classifier and adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import free_name, materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name")
ORDER = {k: i for i, k in enumerate((*BASE, *ADDED))}
#: Possessive loops and starts at the edge of a run give the plain patterns' matches in linear time, without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+",
    "number": r"(?<![A-Za-z0-9_.+@-])\(?[0-9]++\)?(?:[\x20./:-][0-9]++)*+(?![A-Za-z0-9_@])",
    "name": r"(?<![A-Za-zÀ-ÿ])(?!(?:Dear|Mrs?|Ms|Dr|Herr|Frau|Liebe|Lieber|Monsieur|Madame|Cher|Chère|Señora?|Don|Doña) )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)++",
}
NEEDS = {"email": "@", "phone": r"\+", "name": "[a-zß-öø-ÿ] [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]"}
# Gazetteers of English, German, French and Spanish words.
CREDENTIAL_WORDS = ("token", "password", "passwd", "pwd", "secret", "key", "api", "auth", "bearer", "credential", "login", "passwort", "kennwort", "schlüssel", "mot de passe", "clé", "jeton", "contraseña", "clave")
CONTACT_WORDS = ("tel", "phone", "call", "fax", "mobile", "ssn", "iban", "account", "contact", "telefon", "anruf", "konto", "mobil", "téléphone", "portable", "compte", "teléfono", "móvil", "cuenta", "llamar")
PLAIN_WORDS = ("version", "license", "licence", "copyright", "page", "chapter", "isbn", "build", "http", "lizenz", "seite", "kapitel", "chapitre", "página", "capítulo", "licencia", "by-nc", "by-sa", "year", "jahr", "année", "año", "price", "preis", "prix", "precio", "figure", "table")
PERSON_WORDS = ("mr", "mrs", "ms", "dr", "dear", "name", "herr", "frau", "liebe", "lieber", "monsieur", "madame", "cher", "chère", "señor", "señora", "don", "doña", "nombre", "nom")
GIVEN_NAMES = ("Anna", "Maria", "Peter", "Paul", "John", "James", "Mary", "Robert", "Michael", "William", "David", "Sarah", "Emma", "Laura", "Thomas", "Martin", "Julia", "Hans", "Klaus", "Jürgen", "Wolfgang", "Sabine", "Petra", "Monika", "Ursula", "Heike", "Stefan", "Andreas", "Jean", "Pierre", "Marie", "Michel", "Claire", "Sophie", "François", "Nicolas", "Camille", "Chloé", "Luc", "Hélène", "José", "Juan", "Carlos", "Luis", "Ana", "Carmen", "Pedro", "Miguel", "Lucía", "Sofía", "Javier", "Elena")
TITLE_WORDS = ("License", "Licence", "Public", "General", "Apache", "Commons", "Version", "University", "Street", "Chapter", "Table", "Figure", "The", "This", "These", "All", "Rights", "Reserved", "Copyright", "Creative", "Software", "Inc", "Foundation")
CONTEXT = 24
LABELERS = ("format", "checksum", "mix", "named", "plain", "assigned")
SHAPES = {"size": 4, "share": 4, "letters": 4, "groups": 4, "edge": 4}
EM_ROUNDS, FIT_ROUNDS, THRESHOLD = 60, 400, 0.5


def most_patterns() -> int:
    """Rows that the vote and shape columns can take: three votes of each labeler, four values of each shape, kinds."""
    return 3 ** len(LABELERS) * math.prod(SHAPES.values()) * len(ADDED)


def _matches(kind: str) -> Column:
    """Matches of one kind in ``text`` as structs; seg: code points between the last match (or the start) and this."""
    text = F.col("text")
    segs, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    found = F.transform(hits, lambda h, i: F.struct(F.lit(ORDER[kind]).alias("k"), i.alias("i"), F.length(F.get(segs, i)).alias("seg"), h.alias("hit"), F.right(F.get(segs, i), F.lit(CONTEXT)).alias("left")))
    some = text.rlike(NEEDS.get(kind, "[0-9]"))
    return F.when(some, found)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes() -> Column:
    """Whether a base match holds."""
    d = _digits(F.col("hit"))
    n = F.length(d)
    parts = F.transform(F.split("hit", r"\."), lambda p: F.ltrim(p, F.lit("0")))
    in_range = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return F.when(F.col("k") == ORDER["ip"], in_range).when(F.col("k") == ORDER["card"], F.when(n.between(14, 19), _luhn(d)).otherwise(False)).when(F.col("k") == ORDER["phone"], n.between(10, 15)).otherwise(True)


def _luhn(d: Column) -> Column:
    n = F.length(d)
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, F.get(doubled, digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _votes() -> dict[str, Column]:
    """1: personal, 0: not, -1: abstains."""
    hit, left, k = F.col("hit"), F.lower("left"), F.col("k")
    secret, number, name = (k == ORDER[x] for x in ADDED)
    digits = _digits(hit)
    n_digits = F.length(digits)
    n_letters = F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))
    any_of = lambda words, c: c.rlike(r"(?<![\p{L}])(?:" + "|".join(words) + r")(?![\p{L}])")
    known = hit.rlike(r"^(?:[A-Z]{4}[0-9A-Z]{16}|(?=[0-9]*[a-f])[0-9a-f]{16,}|[A-Za-z0-9]{2,8}[_-][A-Za-z0-9]{16,})$") | hit.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$") | hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    date = hit.rlike(r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|(?:1[89]|20)[0-9]{2})$")
    dull = date | hit.rlike(r"^[A-Za-z-]+[0-9]{1,2}$") | hit.rlike(r"^[0-9]{1,6}(?:\.[0-9]{1,3}){0,2}$")
    return {
        "format": F.when(known, 1).when(dull, 0).otherwise(-1),
        "checksum": F.when(number & n_digits.between(14, 19) & ~_luhn(digits), 0).otherwise(-1),
        "mix": F.when(secret & (n_digits >= 4) & (n_letters >= 4), 1).when(secret & (n_digits <= 2), 0).when(number & n_digits.between(9, 13), 1).when(number & (n_digits < 7), 0).otherwise(-1),
        "named": F.when(secret & any_of(CREDENTIAL_WORDS, left) | number & any_of(CONTACT_WORDS, left) | name & (any_of(PERSON_WORDS, left) | any_of(GIVEN_NAMES, hit)), 1).when(name & any_of(TITLE_WORDS, hit), 0).otherwise(-1),
        "plain": F.when(any_of(PLAIN_WORDS, left), 0).otherwise(-1),
        "assigned": F.when(~name & left.rlike("[=:][ \"']*$"), 1).when(number & left.rlike(r"[\p{L}] $"), 0).when(name & left.rlike(r"(?:^|[.!?\n] ?)$"), 0).otherwise(-1),
    }


def _shape() -> dict[str, Column]:
    hit, left = F.col("hit"), F.col("left")
    size, share = F.length(hit), F.length(_digits(hit)) / F.length(hit)
    upper, lower = hit.rlike(r"\p{Lu}"), hit.rlike(r"\p{Ll}")
    return {
        "size": F.when(size < 9, 0).when(size < 16, 1).when(size < 32, 2).otherwise(3),
        "share": F.when(share < 0.15, 0).when(share < 0.4, 1).when(share < 0.8, 2).otherwise(3),
        "letters": F.when(upper & lower, 3).when(upper, 2).when(lower, 1).otherwise(0),
        "groups": F.least(F.length(F.regexp_replace(hit, r"[\p{L}0-9]", "")), F.lit(3)),
        "edge": F.when(left == "", 0).when(left.rlike(r"\s$"), 1).when(left.rlike(r"[=:\"']$"), 2).otherwise(3),
    }


FEATURES = (*LABELERS, *SHAPES, "k")


@dataclass
class SpanModel:
    """What was learned.

    ``priors``: the share of true candidates of each kind; ``on_true``, ``on_false``: each labeler's rate of a yes among
    its votes on true and on false candidates; ``weights``: the classifier's, by a feature's value within a kind.
    """

    priors: dict[int, float]
    on_true: dict[str, float]
    on_false: dict[str, float]
    weights: dict[tuple[int, str, int], float]

    def probability(self) -> Column:
        z = F.lit(0.0)
        for (k, name, value), w in self.weights.items():
            z = z + F.when((F.col("k") == k) & (F.col(name) == value), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def learn(patterns: list[tuple[tuple[int, ...], int]]) -> SpanModel | None:
    """From (FEATURES values, count) rows, over all candidates of the corpus."""
    if not patterns:
        return None
    f, c = np.array([f for f, _ in patterns]), np.array([n for _, n in patterns], float)
    votes, kinds, total = f[:, : len(LABELERS)], f[:, -1], c.sum()
    of_kind = {int(k): kinds == k for k in np.unique(kinds)}
    cast, yes = votes >= 0, votes == 1
    prior, on_true, on_false = np.full(len(c), 0.3), np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.2)
    strength = 0.02 * total + 4  # of the belief that a vote is right four times in five
    for _ in range(EM_ROUNDS):
        likely = [np.where(cast, np.where(yes, np.log(r), np.log(1 - r)), 0).sum(axis=1) for r in (on_true, on_false)]
        post = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + likely[1] - np.log(prior) - likely[0], -500, 500)))
        for who in of_kind.values():
            prior[who] = (post[who] @ c[who] + 0.3 * 4) / (c[who].sum() + 4)
        on_true, on_false = ((((p * c) @ yes) + mean * strength) / (((p * c) @ cast) + strength) for p, mean in ((post, 0.8), (1 - post, 0.2)))
    names = sorted({(int(k), n, int(v)) for row, k in zip(f, kinds, strict=True) for n, v in zip(FEATURES[:-1], row, strict=False)})
    at = {key: i for i, key in enumerate(names)}
    x = np.zeros((len(c), len(names)))
    for i, (row, k) in enumerate(zip(f, kinds, strict=True)):
        x[i, [at[int(k), n, int(v)] for n, v in zip(FEATURES[:-1], row, strict=False)]] = 1
    share = sum(np.where(who, c / c[who].sum(), 0) for who in of_kind.values())  # kinds weigh alike, however rare
    w = np.zeros(len(names))
    for step in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w -= 2.0 / (1 + step / 100) * (((p - post) * share) @ x + 1e-4 * w)
    return SpanModel({k: float(prior[who][0]) for k, who in of_kind.items()}, dict(zip(LABELERS, on_true.tolist(), strict=True)), dict(zip(LABELERS, on_false.tolist(), strict=True)), dict(zip(names, w.tolist(), strict=True)))


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each checked base match and each candidate outside of these: row, doc_id, k, start, end, votes, shapes.

    Other matches, and documents without any, have a null k. ``row`` numbers the rows of ``docs``.
    """
    found = F.filter(F.concat(*[F.coalesce(_matches(k), F.array().cast("array<struct<k:int,i:int,seg:int,hit:string,left:string>>")) for k in ORDER]), lambda x: x.isNotNull())
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))
    rows = numbered.select("row", "doc_id", F.explode_outer("found").alias("m")).select("row", "doc_id", "m.*")
    # offsets: what lies before a match of its kind, in code points
    over = Window.partitionBy("row", "k").orderBy("i")
    end = F.sum(F.col("seg") + F.length("hit")).over(over)
    placed = rows.select("row", "doc_id", "k", "hit", "left", (end - F.length("hit")).alias("start"), end.alias("end"))
    passed = placed.withColumn("k", F.when((F.col("k") >= len(BASE)) | _passes(), F.col("k")))
    base = F.col("k") < len(BASE)
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "end", "k"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("k")))
    inside = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    passed = passed.withColumn("inside", inside).withColumn("k", F.when(base | ~F.col("inside"), F.col("k")))
    return passed.select("row", "doc_id", "k", "start", "end", *[v.cast("int").alias(n) for n, v in {**_votes(), **_shape()}.items()])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> tuple[DataFrame, SpanModel | None]:
    """(row, doc_id, base, added: arrays of (start, k, end)) of each row of ``docs`` (doc_id, text), and the model."""
    found = materialize(candidates(docs.select("doc_id", "text")), "spans")
    counted = found.where(F.col("k") >= len(BASE)).groupBy(*FEATURES).count().collect()
    model = learn(sorted((tuple(r[n] for n in FEATURES), r["count"]) for r in counted))
    likely = model.probability() >= THRESHOLD if model else F.lit(False)
    span = F.struct("start", "k", "end")
    per_row = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(F.col("k") < len(BASE), span))).alias("base"),
        F.sort_array(F.collect_list(F.when((F.col("k") >= len(BASE)) & likely, span))).alias("added"),
    )
    return per_row, model


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of each row of ``find``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == ORDER[kind])).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``docs`` (doc_id, text and others) with each span of ``text`` replaced by its kind; columns stay as they are.

    Overlapping spans are merged under the kind of the first.
    """
    row, mark = free_name(docs, "row"), free_name(docs, "spans")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found, _ = find(numbered.select(F.col(row).alias("doc_id"), "text"))
    names = F.array(*[F.lit(mask.format(k)) for k in ORDER])
    spans = F.array_sort(F.concat("base", "added"))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,k:int,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.get(acc, F.size(acc) - 1)["k"].alias("k"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    marks = found.where(F.size(spans) > 0).select(F.col("doc_id").alias(row), merged.alias(mark))
    at = lambda a, i: F.get(a, i)
    s, t = F.col(mark), F.col("text")
    pieces = F.transform(s, lambda x, i: F.concat(F.substring(t, (F.coalesce(at(s, i - 1)["end"], F.lit(0)) + 1).cast("int"), (x["start"] - F.coalesce(at(s, i - 1)["end"], F.lit(0))).cast("int")), at(names, x["k"])))
    tail = F.substring(t, (at(s, F.size(s) - 1)["end"] + 1).cast("int"), F.length(t))
    text = F.when(s.isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return numbered.join(marks, row, "left").withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
