"""Lexical search: LIKE scoring, trigram BM25, merging, match types and highlights."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.lineage import cut
from tessera.operators import matching
from tessera.operators.matching import Node, Phrase

if TYPE_CHECKING:
    from tessera.operators.textindex import Index

FIELDS = ("title", "abstract", "summary")


def _quoted(x: str) -> str:
    return "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# Expressions are put together as SQL: a search has many, and each Column operation is a call.


def literal(x: object) -> str:
    return str(x) if isinstance(x, int) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def like_score(query: str) -> Column:
    """10, 7 or 5 for the first of title, abstract and summary that is LIKE %query%, else 0;
    % and _ in the query are wildcards. Java ignores the case of ASCII letters alone, as LIKE."""
    parts = (".*" if c == "%" else "." if c == "_" else _quoted(c) for c in re.split("([%_])", query) if c)
    pattern = literal("(?is)" + "".join(parts))
    return F.expr(f"CASE WHEN title RLIKE {pattern} THEN 10 WHEN abstract RLIKE {pattern} THEN 7 WHEN summary RLIKE {pattern} THEN 5 ELSE 0 END")


def like_search(papers: DataFrame, query: str, limit: int) -> DataFrame:
    """Papers by score, then title; ties by paper_id."""
    hits = papers.withColumn("base_score", like_score(query)).filter("base_score > 0")
    return hits.orderBy(F.desc("base_score"), "title", "paper_id").limit(limit)


def parse(query: str) -> tuple[list[Phrase], Node] | None:
    return matching.parse(query, FIELDS)


def _lowered(papers: DataFrame) -> DataFrame:
    """papers plus low_title, ..., their texts in lower case. No filter is pushed below a generator,
    so a text is lowered once, however many phrases are counted in it."""
    return papers.selectExpr("*", f"inline(array(struct({', '.join(f"lower(coalesce({f}, '')) AS low_{f}" for f in FIELDS)})))")


def _frequency(phrase: Phrase) -> str:
    """Overlapping occurrences in the phrase's fields of _lowered() papers; for one that must stand
    first, the fields that start with it."""
    if phrase.text is None or not phrase.fields:
        return "0"
    text = literal(phrase.text)
    if phrase.first:
        return " + ".join(f"cast(startswith(low_{f}, {text}) as int)" for f in phrase.fields)
    overlapping = literal(f"(?={_quoted(phrase.text)})")
    return " + ".join(f"CASE WHEN contains(low_{f}, {text}) THEN regexp_count(low_{f}, {overlapping}) ELSE 0 END" for f in phrase.fields)


def _near(phrases: list[Phrase], distance: int) -> Column:
    """For each of the phrases, its occurrences that are near all the others; null where one is
    missing. Only texts that have them all reach Python."""
    texts = [p.text for p in phrases]
    if None in texts or not phrases[0].fields:
        return F.lit(None).cast("array<int>")
    fields = phrases[0].fields
    sizes = [len(t) - 2 for t in texts]

    def counts(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            found = [matching.near_counts([matching.places_of(x, t) for t in texts], sizes, distance) for x in row if x]
            out.append([sum(c) for c in zip(*found, strict=True)] or [0] * len(texts))
        return pd.Series(out)

    # a field without all of them cannot have them near
    whole = [F.expr(f"CASE WHEN {' AND '.join(f'contains(low_{f}, {literal(t)})' for t in texts)} THEN low_{f} END") for f in fields]
    return F.when(F.coalesce(*whole).isNotNull(), F.pandas_udf(counts, "array<int>")(*whole))


def _nears(node: Node) -> list[tuple]:
    if node is None or node[0] == "phrase":
        return []
    return [node] if node[0] == "near" else [n for x in node[1:] for n in _nears(x)]


_SIZE = " + ".join(f"greatest(length(coalesce({f}, '')) - 2, 0)" for f in FIELDS)


def sized(papers: DataFrame) -> DataFrame:
    """papers plus d, the number of their trigrams."""
    return papers.withColumn("d", F.expr(_SIZE))


def counted(papers: DataFrame, phrases: list[Phrase], tree: Node, *others: Column) -> DataFrame:
    """papers plus d, f0, f1, ..., the frequencies of the phrases, near0, near1, ..., and others."""
    nears = [_near([phrases[k] for k in n[1]], n[2]).alias(f"near{g}") for g, n in enumerate(_nears(tree))]
    size = [] if "d" in papers.columns else [F.expr(_SIZE).alias("d")]
    return _lowered(papers).select(*papers.columns, *size, *(F.expr(_frequency(p)).alias(f"f{k}") for k, p in enumerate(phrases)), *nears, *others)


def _matches(node: Node, groups: dict[tuple, int]) -> str:
    if node is None:
        return "false"
    if node[0] == "phrase":
        return f"f{node[1]} > 0"
    if node[0] == "near":
        return f"coalesce(near{groups[node]}[0] > 0, false)"
    parts = [f"({_matches(x, groups)})" for x in node[1:]]
    return f"{parts[0]} AND NOT {parts[1]}" if node[0] == "not" else f" {node[0].upper()} ".join(parts)


def _counting(node: Node, groups: dict[tuple, int], given: str = "") -> list[tuple[int, str]]:
    """(phrase, frequency) of the phrases that count for the rank of a paper that matches: those
    below alternatives that match, not those that must be absent."""
    if node is None:
        return []
    where = lambda x: f"CASE WHEN {given} THEN {x} ELSE 0 END" if given else x
    if node[0] == "phrase":
        return [(node[1], where(f"f{node[1]}"))]
    if node[0] == "near":
        return [(k, where(f"coalesce(near{groups[node]}[{i}], 0)")) for i, k in enumerate(node[1])]
    if node[0] == "not":
        return _counting(node[1], groups, given)
    out = []
    for x in node[1:]:
        own = _matches(x, groups) if node[0] == "or" and x[0] in ("and", "not") else ""
        out += _counting(x, groups, " AND ".join(f"({c})" for c in (given, own) if c))
    return out


def totals(papers: DataFrame) -> tuple[int, float]:
    """Number and mean size of the papers, as bm25 needs them."""
    found = sized(papers).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg_d")).first()
    return found["n"], found["avg_d"] or 1.0


def ranked(rows: DataFrame, parsed: tuple[list[Phrase], Node], known: tuple[int, float] | None = None, small: bool = False) -> DataFrame:
    """rows of counted() plus rank, null where the tree does not match; the best rank is least.
    known are the totals of all papers where rows has only those with any phrase. The statistics
    are one row, which a job of its own finds, or, for a small number of rows, a window."""
    phrases, tree = parsed
    numbers = [f"count_if(f{k} > 0)" for k in range(len(phrases))]
    if small:
        n, mean = known
        rows = rows.selectExpr("*", *(f"{x} OVER () AS n{k}" for k, x in enumerate(numbers)))
        held = [f"n{k}" for k in range(len(phrases))]
    else:
        stats = rows.selectExpr("count(*) AS n", "avg(d) AS avg_d", *(f"{x} AS n{k}" for k, x in enumerate(numbers))).first()
        n, mean = known or (stats["n"], stats["avg_d"] or 1.0)
        held = [str(stats[f"n{k}"]) for k in range(len(phrases))]
    groups = {g: i for i, g in enumerate(_nears(tree))}
    rank = "0D"
    for k, f in _counting(tree, groups):
        idf = f"ln(({n} - {held[k]} + 0.5D) / ({held[k]} + 0.5D))"
        rank += f" - CASE WHEN {idf} <= 0 THEN 1e-6D ELSE {idf} END * ({f}) * 2.2D / (({f}) + 1.2D * (0.25D + 0.75D * d / {mean!r}D))"
    made = {f"{c}{k}" for c in "nf" for k in range(len(phrases))} | {f"near{g}" for g in range(len(groups))}
    return rows.select(*(c for c in rows.columns if c not in made), F.expr(f"CASE WHEN {_matches(tree, groups)} THEN {rank} END").alias("rank"))


def bm25(papers: DataFrame, query: str, known: tuple[int, float] | None = None, small: bool = False) -> DataFrame:
    """(paper_id, rank) of the papers that match an index query."""
    parsed = parse(query) or ([], None)
    rows = counted(papers, *parsed)
    rows = rows.select("paper_id", *(c for c in rows.columns if c == "d" or c not in papers.columns))
    if known and parsed[0]:
        rows = rows.filter(_any(parsed[0]))
    if small:
        rows = rows.repartition(1)
    elif parsed[0]:
        rows = cut(rows)
    return ranked(rows, parsed, known, small).filter("rank is not null").select("paper_id", "rank")


def _any(phrases: list[Phrase]) -> str:
    return " OR ".join(f"f{k} > 0" for k in range(len(phrases)))


def match_type(query: str, whole_words: bool = False) -> Column:
    low = query.lower()
    if whole_words:
        hit = lambda f: F.lower(F.coalesce(f, F.lit(""))).rlike(f"{T.EDGE}{_quoted(low)}{T.EDGE}")
    else:
        hit = lambda f: F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(low))
    return F.coalesce(F.nullif(F.concat_ws("+", *(F.when(hit(F.col(f)), f) for f in FIELDS)), F.lit("")), F.lit("unknown"))


def highlight(text: Column, query: str, most: int = 300) -> Column:
    """A window around the first match with every match in it marked, else the start."""
    text = F.coalesce(text, F.lit(""))
    at = F.locate(query.lower(), F.lower(text)) - 1
    start = F.greatest(at - 80, F.lit(0))
    end = F.least(F.length(text), at + len(query) + 200)
    snippet = F.regexp_replace(F.substring(text, start + 1, end - start), f"(?iu){_quoted(query)}", "**$0**")
    return F.when(at < 0, F.substring(text, 1, most)).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), snippet, F.when(end < F.length(text), "...").otherwise("")))


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows of a small number with like_at and fts_at, their places by score and by rank; those
    within the limit in either."""
    rows = rows.selectExpr(
        "* EXCEPT (base_score, rank)", "CASE WHEN base_score > 0 THEN base_score END AS base_score", "rank",
        "row_number() OVER (ORDER BY base_score > 0 DESC, base_score DESC, title, paper_id) AS like_at", "row_number() OVER (ORDER BY rank NULLS LAST, paper_id) AS fts_at",
    )
    inside = {"base_score": f"base_score IS NOT NULL AND like_at <= {limit}", "rank": f"rank IS NOT NULL AND fts_at <= {limit}"}
    rows = rows.selectExpr("* EXCEPT (base_score, rank, like_at, fts_at)", *(f"CASE WHEN {inside[v]} THEN {c} END AS {c}" for v, c in (("base_score", "base_score"), ("base_score", "like_at"), ("rank", "rank"), ("rank", "fts_at"))))
    return rows.filter("like_at IS NOT NULL OR fts_at IS NOT NULL")


def _found(papers: DataFrame, query: str, parsed: tuple[list[Phrase], Node] | None, limit: int, index: Index | None) -> DataFrame:
    """The same for any number of papers: their texts are read once for scores and counts, which
    are written; the limit of each kind is taken from these, then the texts of what was taken."""
    place = ["segment", "block", "pos"] if index else []
    phrases, tree = parsed or ([], None)
    rows = counted(papers, phrases, tree, like_score(query).alias("base_score"))
    rows = rows.select("paper_id", *place, "title", *(c for c in rows.columns if c == "d" or c not in papers.columns))
    if index:
        rows = rows.filter(" OR ".join(filter(None, ("base_score > 0", _any(phrases)))))
    rows = cut(rows)
    found = rows.filter("base_score > 0").orderBy(F.desc("base_score"), "title", "paper_id").limit(limit)
    found = found.withColumn("like_at", F.row_number().over(Window.orderBy(F.desc("base_score"), "title", "paper_id"))).select("paper_id", *place, "base_score", "like_at")
    if parsed is None:
        found = found.withColumns({"rank": F.lit(None).cast("double"), "fts_at": F.lit(None).cast("int")})
    else:
        best = ranked(rows, parsed, index.totals if index else None).filter("rank is not null").orderBy("rank", "paper_id").limit(limit)
        best = best.withColumn("fts_at", F.row_number().over(Window.orderBy("rank", "paper_id"))).select("paper_id", *place, "rank", "fts_at")
        found = found.join(F.broadcast(best), ["paper_id", *place], "full_outer")
    # at most 2 * limit rows from here on
    if index:
        held: dict[tuple[str, int], set] = {}
        for r in found.select(*place).collect():
            held.setdefault((r["segment"], r["block"]), set()).add(r["pos"])
        papers, found = index.read(held), found.drop(*place)
    return papers.join(F.broadcast(found), "paper_id")


def search(papers: DataFrame, query: str, top_k: int = 10, index: Index | None = None) -> DataFrame:
    """(position, paper_id, title, filename, abstract_preview, summary, match_type, score). With
    an index of the papers, only those that its lists give are read."""
    query = (query or "").strip()
    if not query or top_k < 1:
        papers, index = papers.limit(0), None
    limit = top_k + 10
    parsed = parse(query) if len(query) >= 3 else None
    if index:
        papers, small = index.rows(parsed[0] if parsed else [], query)
    if index and small:
        rows = counted(papers, *(parsed or ([], None)), like_score(query).alias("base_score"))
        rows = rows.filter(" OR ".join(filter(None, ("base_score > 0", _any(parsed[0] if parsed else []))))).repartition(1)
        found = _placed(ranked(rows, parsed, index.totals, True) if parsed else rows.withColumn("rank", F.lit(None).cast("double")), limit)
    else:
        found = _found(papers, query, parsed, limit, index)
    score = F.greatest(F.col("base_score").cast("double"), 15 - (F.col("rank") + 1))
    place = [F.desc("score"), F.col("like_at").asc_nulls_last(), F.col("fts_at").asc_nulls_last()]
    found = found.withColumn("score", score).orderBy(*place).limit(top_k).withColumn("place", F.row_number().over(Window.orderBy(*place)))
    out = found.withColumn("abstract_preview", highlight(F.col("abstract"), query)).withColumn("match_type", match_type(query))
    if len(query) <= 4 and query.isascii():
        # whole-word hits first; the others stay after them
        shown = out.withColumn("abstract", F.replace("abstract_preview", F.lit("**"), F.lit("")))
        out = shown.withColumn("match_type", match_type(query, whole_words=True))
        exact = F.col("match_type") != "unknown"
        out = out.withColumn("position", F.row_number().over(Window.orderBy(F.desc(exact), "place")))
    else:
        out = out.withColumn("position", F.col("place"))
    columns = ["position", "paper_id", "title", *(["filename"] if "filename" in papers.columns else []), "abstract_preview", "summary", "match_type", F.round("score", 1).alias("score")]
    return out.select(*columns)
