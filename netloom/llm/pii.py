"""PII: information-theoretic sanitisation.

Personal data are found by pattern. Then the corpus is asked which terms give them away: a term in the documents
of an entity discloses it as far as their pointwise mutual information comes up to the entity's own information
content. Terms beyond a first threshold are generalised wherever they stand in that entity's documents, beyond a
second removed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded, materialise, table
from netloom.llm.word_counts import word_counts

KINDS = ("email", "ip", "card", "phone")
#: Kinds of terms that the corpus marks as disclosing.
TERM_KINDS = ("generalise", "remove")
#: Distinct texts (copies count once) in which a term must stand with an entity before it can be held to disclose it.
SUPPORT = 2
#: Shares of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.85

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The leftmost match begins where a run of digits begins: one that began within it could begin earlier. So no run is
#: gone through again from each of its digits, and a text of digits takes linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = str.maketrans("", "", " -().+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: all of a run of local characters before an @ that a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal data by pattern, in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := m[0].translate(_DIGITS)) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_DIGITS)) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(kind: str, match: str) -> str:
    return f"{kind}:{match.lower() if kind == 'email' else match.translate(_DIGITS) if kind != 'ip' else match}"


def _words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[int]]]:
    """(term, starts) of the text's distinct words, A-Z in lower case, that no span overlaps."""
    out: dict[str, list[int]] = {}
    taken, k, end = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end, k = max(end, taken[k][1]), k + 1
        if end <= m.start():
            out.setdefault(m[0].translate(_FOLD), []).append(m.start())
    return list(out.items())


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, words array<struct<term:string,starts:array<int>>>"


def _found(text_col: str):
    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = base_spans(text)
            n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            entities = sorted({_entity(k, text[a:b]) for k, a, b in spans})
            rows.append((*n, joined(spans), entities, [{"term": t, "starts": at} for t, at in _words(text, spans)] if spans else []))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "entities", "words"])

    return found(F.col(text_col))


def entity_classes(texts: DataFrame) -> DataFrame:
    """(entity, class, n_e) of the entities that stand in enough distinct texts. Entities of one class stand in the same texts, so the
    same terms disclose them: an address book in two texts is one class, however long it is. Sets of texts are told apart by
    their size and two sums of 64-bit hashes, which are added up before the shuffle."""
    holders = texts.select("text_key", "copies", F.explode("entities").alias("entity"))
    sum_of = lambda seed: F.sum(F.xxhash64("text_key", F.lit(seed)).cast("decimal(38,0)"))
    sets = holders.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), sum_of(1).alias("a"), sum_of(2).alias("b"))
    return sets.where(F.col("texts") >= SUPPORT).select("entity", F.md5(F.concat_ws(" ", "texts", "a", "b").cast("binary")).alias("class"), "n_e")


def _by_class(docs: DataFrame, texts: DataFrame, classes: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(class, term, kind) of the terms that disclose a class of entities, and (text_key, class) of the texts that hold one."""
    holders = texts.select("text_key", "copies", F.explode("entities").alias("entity")).join(bounded(classes), "entity")
    held = materialise(holders.select("text_key", "copies", "class", "n_e").distinct())
    shared = held.join(texts.select("text_key", "words"), "text_key").select("class", "n_e", "copies", F.explode("words.term").alias("term"))
    pairs = shared.groupBy("class", "n_e", "term").agg(F.count("*").alias("support"), F.sum("copies").alias("n_et")).where(F.col("support") >= SUPPORT)
    pairs = materialise(pairs)
    if not pairs.take(1):
        return pairs.select("class", "term", F.lit("").alias("kind")), held
    words = pairs.select("term").distinct()
    n_t = word_counts(docs, text_col, by_text=True).select(F.col("word").alias("term"), F.col("n").alias("n_t")).join(words, "term")
    n = F.lit(docs.count())
    pmi = F.log2(n * F.least("n_et", "n_t", "n_e") / (F.col("n_e") * F.col("n_t")))
    ratio = F.when(F.col("n_e") < n, pmi / F.log2(n / F.col("n_e"))).otherwise(F.lit(0.0))
    kind = F.when(ratio >= REMOVE, TERM_KINDS[1]).when(ratio >= GENERALISE, TERM_KINDS[0])
    return pairs.join(n_t, "term").select("class", "term", kind.alias("kind")).where("kind is not null"), held


def disclosing_terms(docs: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, kind) of the terms that disclose an entity, from all documents.

    texts(text_key, entities, words, copies) has a row for each distinct text with entities. With n documents in all, PMI is
    log2(n n(e,t) / (n(e) n(t))) and the entity's information log2(n / n(e)); their ratio is the disclosure,
    1 for a term that the corpus has nowhere but with the entity. All counts are of documents.
    """
    classes = materialise(entity_classes(texts))
    flagged, _ = _by_class(docs, texts, classes, text_col)
    return classes.join(flagged, "class").select("entity", "term", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, text_key, n_email, n_ip, n_card, n_phone, base, terms) for each row of docs.

    base has the spans found by pattern as kind:start:end; terms is an array of (kind, start, end) that the
    corpus adds: all places of a term in a text that holds the entity it discloses. A null text counts as empty:
    no spans. What is found depends on the text alone, so rows are told apart by a hash of it.
    """
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _found(text_col).alias("r")).select("id", "text_key", "r.*")
    found = materialise(found)
    texts = found.where(F.size("entities") > 0).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    texts = materialise(texts)
    flagged, held = _by_class(docs, texts, materialise(entity_classes(texts)), text_col)
    flagged = materialise(flagged)
    # only texts of classes that have such terms are opened up again
    known = held.join(bounded(flagged.select("class").distinct()), "class").select("text_key", "class")
    words = known.join(texts.select("text_key", "words"), "text_key").select("text_key", "class", F.explode("words").alias("w")).select("text_key", "class", "w.*")
    places = words.join(bounded(flagged), ["class", "term"]).select("text_key", "kind", "term", F.explode("starts").alias("start"))
    span = F.struct("kind", "start", (F.col("start") + F.length("term")).alias("end"))
    terms = places.groupBy(F.col("text_key").alias("of_key")).agg(F.array_sort(F.collect_set(span)).alias("terms"))
    terms = materialise(terms)  # apart from the join, which adaptive execution can then split where a text has many copies
    both = F.col("text_key") == F.col("of_key")
    return found.drop("entities", "words").join(terms, both, "left").select(F.col("id").alias(id_col), "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "terms")


def _cleaned(text: str, terms) -> str:
    marks = [(a, b, f"<{k.upper()}>") for k, a, b in base_spans(text)]
    # patterns may overlap one another: the leftmost, then the longest, wins
    out, end = [], 0
    marks += [(t["start"], t["end"], "<TERM>" if t["kind"] == TERM_KINDS[0] else "") for t in (terms if terms is not None else ())]
    for a, b, mark in sorted(marks, key=lambda m: (m[0], -m[1], m[2])):
        if a >= end:
            out += [text[end:a], mark]
            end = b
    return "".join(out) + text[end:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with personal data in the text replaced by their kind, and disclosing terms
    by <TERM> or nothing. A null text stays null. Only documents with such terms are looked up in a join."""
    spans = find(docs, id_col, text_col).where(F.size("terms") > 0).select(F.col(id_col).alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.col("terms").alias("_pii_terms"))
    spans = bounded(materialise(spans.dropDuplicates(["_pii_id", "_pii_key"])), weight=F.size("_pii_terms"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _cleaned(t, x) for t, x in zip(texts, terms)], dtype=object)

    joined_up = docs.join(spans, [F.col(id_col).eqNullSafe(F.col("_pii_id")), F.xxhash64(text_col) == F.col("_pii_key")], "left")
    return joined_up.withColumn(text_col, clean(text_col, "_pii_terms")).select(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents: counts and spans of personal data, and the spans that the corpus adds.

    Null and empty texts have none. Repeated rows have the spans of their text each; null ids do no harm, as spans
    belong to texts. Where a term discloses two entities of a text by different degrees, both kinds of span are listed.
    Extra columns are not read; an empty table gives no rows.
    """
    found = find(table(spark, sf_dir, "documents"))

    @F.pandas_udf("string")
    def all_spans(base: pd.Series, terms: pd.Series) -> pd.Series:
        added = [sorted(((t["kind"], t["start"], t["end"]) for t in x), key=lambda t: (TERM_KINDS.index(t[0]), t[1])) if x is not None else [] for x in terms]
        return pd.Series([",".join(filter(None, (b, joined(a)))) for b, a in zip(base, added)], dtype=object)

    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), all_spans("base", "terms").alias("spans"))
