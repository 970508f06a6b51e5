"""The registered queries of the engine's own operators, each over its whole table, with the
DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.lineage import cut, session_dir
from tessera.operators import catalog, chunk, convert, dedup, layout, lexical, papers, semantic, textindex, vector
from tessera.plans import snapshot
from tessera.sources import documents as folders
from tessera.sources import markdown_folder as markdown_files
from tessera.streaming.sync import drive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


# ---- text functions ----

_MARKED = "coalesce(text, '') || '  [1, 2] see https://a.b/c and doi: 10.1/x end'"
_CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\n+', chr(10), 'g'), ' {{2,}}', ' ', 'g'), '\[\d+(?:,\s*\d+)*\]', '', 'g'), 'https?://\S+', '', 'g'), '(?i)\bdoi:\s*10\.\S+', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT doc_id, {_CLEAN_SQL.format(x=_MARKED)} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_text(F.concat("text", F.lit("  [1, 2] see https://a.b/c and doi: 10.1/x end"))).alias("clean"))


_WORDS_SQL = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


@query(f"""
WITH c AS (SELECT doc_id, {_CLEAN_SQL.format(x="coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n\\s*\\n')) AS para, generate_subscripts(regexp_split_to_array(t, '\\n\\s*\\n'), 1) AS pi FROM c WHERE length(t) >= 20),
w AS (SELECT doc_id, pi, {_WORDS_SQL.format(x="para")} AS ws FROM p),
s AS (SELECT doc_id, pi, unnest(range(0, len(ws), 100)) AS st, ws FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pi, st) - 1 AS INTEGER) AS chunk_index, array_to_string(list_slice(ws, st + 1, st + 100), ' ') AS chunk_text FROM s""")
def chunk_words(spark, sf_dir):
    return chunk.chunk_documents(documents(spark, sf_dir), "doc_id").select("doc_id", "chunk_index", F.col("text").alias("chunk_text"))


@query(f"""
WITH d AS (SELECT doc_id, '1. Introduction' || chr(10) || 'https://a.b/' || doc_id || chr(10) || coalesce(text, '') || chr(10) || 'https://a.b/c' || chr(10) || 'Results:' || chr(10) || 'the end of document ' || doc_id AS x FROM documents),
c AS (SELECT doc_id, {_CLEAN_SQL.format(x="x")} AS t FROM d),
p AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n\\s*\\n')) AS para, generate_subscripts(regexp_split_to_array(t, '\\n\\s*\\n'), 1) AS pi FROM c),
h AS (SELECT doc_id, pi, para, trim(split_part(trim(para, ' ' || chr(10)), chr(10), 1)) AS line FROM p),
k AS (SELECT doc_id, pi, para, CASE WHEN rtrim(lower(line), '.: ') IN ('abstract','introduction','background','related work','method','methodology','experiment','experimental','results','result','discussion','conclusion','conclusions','nomenclature','acknowledgment','acknowledgements','references','bibliography') OR (regexp_matches(rtrim(lower(line), '.: '), '^\\d+(\\.\\d+)*[.\\s]+[a-z]') AND len(string_split(trim(regexp_replace(rtrim(lower(line), '.: '), '^\\d+(\\.\\d+)*[.\\s]+', '')), ' ')) <= 8) THEN line[:60] END AS det FROM h),
s AS (SELECT doc_id, pi, coalesce(last_value(det IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pi), 'Abstract') AS section, {_WORDS_SQL.format(x="para")} AS ws FROM k)
SELECT doc_id, section, CAST(sum(ceil(len(ws) / 100.0)) AS BIGINT) AS chunks, CAST(sum(len(ws)) AS BIGINT) AS words FROM s WHERE len(ws) > 0 GROUP BY ALL""")
def chunk_sections(spark, sf_dir):
    x = F.concat(F.lit("1. Introduction\nhttps://a.b/"), "doc_id", F.lit("\n"), "text", F.lit("\nhttps://a.b/c\nResults:\nthe end of document "), "doc_id")
    chunks = chunk.chunk_documents(documents(spark, sf_dir).select("doc_id", x.alias("text")), "doc_id")
    return chunks.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size(T.words(F.col("text")))).alias("words"))


_HEADER = """CASE WHEN rtrim(lower({l}), '.: ') IN ('abstract','introduction','background','related work','method','methodology','experiment','experimental','results','result','discussion','conclusion','conclusions','nomenclature','acknowledgment','acknowledgements','references','bibliography') OR (regexp_matches(rtrim(lower({l}), '.: '), '^\\d+(\\.\\d+)*[.\\s]+[a-z]') AND len(string_split(trim(regexp_replace(rtrim(lower({l}), '.: '), '^\\d+(\\.\\d+)*[.\\s]+', '')), ' ')) <= 8) THEN {l}[:60] END"""


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Results:' WHEN 1 THEN '2.1 Setup of ' || lang WHEN 3 THEN 'References' END AS section, {_HEADER.format(l="trim(split_part(coalesce(text, ''), chr(10), 1))")} AS own FROM documents""")
def section_header(spark, sf_dir):
    line = F.element_at(F.array(F.lit("Results: "), F.concat(F.lit(" 2.1 Setup of "), "lang"), F.concat(F.lit("III. Setup of "), "lang"), F.lit("References")), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", T.section_header(line).alias("section"), T.section_header(F.substring_index("text", "\n", 1)).alias("own"))


@query("""SELECT doc_id, substr(sha256(source || '/' || doc_id || '.pdf'), 1, 12) AS by_path, substr(sha256('10.' || doc_id || '/ab'), 1, 12) AS by_doi, substr(sha256('zotero:k' || doc_id || ':' || doc_id), 1, 12) AS by_item FROM documents""")
def paper_ids(spark, sf_dir):
    doi = F.concat(F.lit(" 10."), "doc_id", F.lit("/AB.. "))
    key = F.concat(F.lit("k"), "doc_id")
    return documents(spark, sf_dir).select("doc_id", T.paper_id(F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf"))).alias("by_path"), T.item_paper_id(doi, key, F.col("doc_id")).alias("by_doi"), T.item_paper_id(F.lit(""), key, F.col("doc_id")).alias("by_item"))


@query("SELECT o_orderkey, regexp_extract(CAST(o_orderdate AS VARCHAR), '(\\d{4})', 1) AS year, '10.1/' || o_orderkey AS doi FROM orders")
def years_and_dois(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.year(F.col("o_orderdate").cast("string")).alias("year"), T.doi_norm(F.concat(F.lit(" 10.1/"), "o_orderkey", F.lit(". "))).alias("doi"))


_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_MD = "'# Title' || chr(10) || '![alt](a.png) and [link](http://x)' || chr(10) || '**bold** x_y' || chr(10) || '~~~' || chr(10) || 'code' || chr(10) || '~~~' || chr(10) || '---' || chr(10) || chr(10) || chr(10) || coalesce(text, '')"
_REWRITES = (
    (r"```[\s\S]*?```", ""), (r"~~~[\s\S]*?~~~", ""), (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", r"\1"), ("_{1,3}([^_]+)_{1,3}", r"\1"),
    (r"(?m)^\|(.+)\|$", r"\1"), (r"(?m)^[-:| ]+$", ""), (r"\|", " "), (r"(?m)^[-*_]{3,}\s*$", ""), ("<[^>]+>", ""), (r"\n{3,}", "\n\n"),
)


def _rewritten(x: str, rewrites) -> str:
    for pattern, by in rewrites:
        by = f"'{by}'" if "\n" not in by else "chr(10) || chr(10)"
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


@query(f"SELECT doc_id, {_TRIM.format(x=_rewritten(_MD, _REWRITES))} AS plain FROM documents")
def markdown_to_text(spark, sf_dir):
    md = F.concat(F.lit("# Title\n![alt](a.png) and [link](http://x)\n**bold** x_y\n~~~\ncode\n~~~\n---\n\n\n"), "text")
    return documents(spark, sf_dir).select("doc_id", T.markdown_to_text(md).alias("plain"))


_TURN = "coalesce(text, '')"


@query(f"SELECT conv_id, turn, {_TRIM.format(x=_rewritten(_TURN, _REWRITES))} AS plain FROM conversations")
def markdown_to_text_all(spark, sf_dir):
    """Every turn of every conversation, as it stands."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.markdown_to_text(F.coalesce("text", F.lit(""))).alias("plain"))


@query(r"SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_chars, CAST(len(regexp_extract_all(html, '<[^>]+>')) AS BIGINT) AS tags FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("text_chars"), F.regexp_count("html", F.lit("<[^>]+>")).cast("long").alias("tags"))


@query("SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title FROM part")
def filename_titles(spark, sf_dir):
    name = F.concat(F.lit("/kb/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "  (科研通-ablesci.com) (1)").otherwise(" "), F.lit("_12.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_from_filename(name).alias("title"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, 'Journal of X' || chr(10) || '  Elsevier 2020' || chr(10) || chr(10) || coalesce(text, '') AS t FROM documents))
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(line, '(?i)^\s*(?:journal of|international|applied|energy|thermal|heat and mass|electrochimica|renewable|sustainable|©|copyright|published by|elsevier|springer|mdpi|http|doi:|vol\.|pp\.|issn|isbn)')), '') AS body FROM documents d JOIN l USING (doc_id) GROUP BY d.doc_id""")
def strip_header(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.strip_journal_header(F.concat(F.lit("Journal of X\n  Elsevier 2020\n\n"), "text")).alias("body"))


_BOILER = r"(?i)^\s*(?:journal of|international|applied|energy|thermal|heat and mass|electrochimica|renewable|sustainable|©|copyright|published by|elsevier|springer|mdpi|http|doi:|vol\.|pp\.|issn|isbn)"


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(' pre' || chr(10) || ' fi- xed  ' || coalesce(text, '') || ' Keywords: a, b' || chr(10) || 'c', '(?is)\b(?:Keywords?|K E Y W O R D S?|Key words?)\b[:\s]*.*$', ''), '\s+', ' ', 'g'), '([\p{{L}}\p{{N}}_])-\s([\p{{L}}\p{{N}}_])', '\1\2', 'g')) AS abstract FROM documents""")
def clean_abstract(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_abstract(F.concat(F.lit(" pre\n fi- xed  "), "text", F.lit(" Keywords: a, b\nc"))).alias("abstract"))


@query(ORACLE_SQL["clean_abstract"].replace("doc_id", "item_id").replace("documents", "benchmark"))
def clean_abstract_all(spark, sf_dir):
    """The benchmark's passages."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.clean_abstract(F.concat(F.lit(" pre\n fi- xed  "), F.coalesce("text", F.lit("")), F.lit(" Keywords: a, b\nc"))).alias("abstract"))


@query(rf"""SELECT doc_id, 'The study of ' || doc_id || ' shows that all of it holds.' AS abstract, true AS found FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'We ask how item ' || doc_id || ' behaves under a heavy load.', true FROM documents WHERE doc_id % 2 = 1""")
def extract_abstract(spark, sf_dir):
    spaced = F.concat(F.lit("A B S T R A C T\n The study of "), "doc_id", F.lit(" shows that all of it holds.\nKeywords: a; b\n"), "text")
    plain = F.concat(F.lit("Some header\nAbstract: "), F.lit(""), F.lit("We ask how item "), "doc_id", F.lit(" behaves under a heavy load. 1. Introduction\n"), "text")
    plain = F.regexp_replace(plain, "Abstract: ", "Abstract ")
    found = documents(spark, sf_dir).select("doc_id", T.extract_abstract(F.when(F.col("doc_id") % 2 == 0, spaced).otherwise(plain)).alias("a"))
    return found.select("doc_id", "a.abstract", "a.found")


@query(rf"""
WITH d AS (SELECT doc_id, {_TRIM.format(x="coalesce(text, '')")} AS own, substr(coalesce(text, ''), 1, 5000) AS head FROM documents),
t AS (SELECT doc_id, CASE WHEN length(own) >= 30 THEN own ELSE array_to_string(list_filter(string_split(head, chr(10)), lambda x: {_TRIM.format(x="x")} <> '' AND NOT regexp_matches(x, '{_BOILER}')), chr(10)) END AS t FROM d),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format(x="x")}), lambda x: x <> '') AS ss FROM t),
u AS (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM s),
r AS (SELECT doc_id, x, i, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT documents.doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS summary FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id AND before < 200 GROUP BY documents.doc_id""")
def summaries(spark, sf_dir):
    """A text that is too short for an abstract is summed up as a full text."""
    return documents(spark, sf_dir).select("doc_id", T.summarize(F.col("text"), F.col("text")).alias("summary"))


@query(ORACLE_SQL["summaries"].replace("doc_id", "item_id").replace("documents", "benchmark"))
def summaries_all(spark, sf_dir):
    """The benchmark's passages."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.summarize(F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))).alias("summary"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[一-鿿㐀-䶿]')) AS chinese FROM documents GROUP BY lang")
def chinese_documents(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.has_chinese(F.col("text"))).alias("chinese"))


_TITLE = r"trim(regexp_replace(replace(replace(lower(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[^\p{L}\p{N}_\s]', ' ', 'g')), 'ß', 'ss'), 'ſ', 's'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_TITLE} AS title_norm FROM documents")
def title_norms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_title(F.substring_index("text", "\n", 1)).alias("title_norm"))


@query(f"SELECT conv_id, turn, {_TITLE} AS title_norm FROM conversations")
def title_norms_all(spark, sf_dir):
    """The first lines of all turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_title(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).alias("title_norm"))


@query("SELECT doc_id, CASE WHEN 100 * n_chars < 1024 THEN (100 * n_chars) || ' B' WHEN 100 * n_chars < 1048576 THEN printf('%.1f', 100 * n_chars / 1024.0) || ' KB' ELSE printf('%.1f', 100 * n_chars / 1048576.0) || ' MB' END AS size, CASE WHEN n_chars < 60 THEN n_chars || 's' ELSE (n_chars // 60) || 'm ' || (n_chars % 60) || 's' END AS elapsed, CAST(n_chars AS INTEGER) AS page, CAST(n_chars + 1 AS INTEGER) AS pages FROM documents")
def display_values(spark, sf_dir):
    n = F.col("n_chars")
    p = T.progress(F.concat(F.lit("done Page "), n, F.lit(" / "), n + 1))
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(100 * n).alias("size"), T.elapsed(n).alias("elapsed"), p["page"].alias("page"), p["pages"].alias("pages"))


# ---- lexical search; papers are documents ----


def doc_papers(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.concat_ws(" ", "source", "lang").alias("summary"), F.concat("doc_id", F.lit(".pdf")).alias("filename"))


_PAPERS_SQL = "p AS (SELECT doc_id AS paper_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS abstract, source || ' ' || lang AS summary, doc_id || '.pdf' AS filename FROM documents)"
_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like_sql(q: str) -> str:
    hit = lambda c: f"{_FOLD.format(x=c)} LIKE '%{q}%'"
    return f"CASE WHEN {hit('title')} THEN 10 WHEN {hit('abstract')} THEN 7 WHEN {hit('summary')} THEN 5 ELSE 0 END"


_indexes: dict[tuple[str, str], textindex.Index] = {}


def doc_index(spark, sf_dir) -> textindex.Index:
    """The search index of the documents, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        folder = session_dir(spark, "index")
        _indexes[key] = textindex.Index(spark, folder, textindex.write_index(doc_papers(spark, sf_dir), folder))
    return _indexes[key]


def _bm25(spark, sf_dir, q: str) -> DataFrame:
    index = doc_index(spark, sf_dir)
    rows, small = index.rows(lexical.parse(q)[0])
    return lexical.bm25(rows, q, index.totals, small).select("paper_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_PAPERS_SQL} SELECT paper_id, {_like_sql('ther_ble')} AS base_score FROM p WHERE {_like_sql('ther_ble')} > 0 ORDER BY 2 DESC, title, paper_id LIMIT 20")
def like_search(spark, sf_dir):
    return lexical.like_search(doc_index(spark, sf_dir).rows([], "theR_ble")[0], "theR_ble", 20).select("paper_id", "base_score")


def _match_sql(q: str) -> str:
    part = lambda c: f"CASE WHEN contains(lower({c}), '{q}') THEN '{c}' END"
    return f"coalesce(nullif(concat_ws('+', {part('title')}, {part('abstract')}, {part('summary')}), ''), 'unknown')"


@query(f"WITH {_PAPERS_SQL} SELECT paper_id, {_match_sql('src1')} AS by_source, {_match_sql('able')} AS by_text FROM p")
def match_types(spark, sf_dir):
    return doc_papers(spark, sf_dir).select("paper_id", lexical.match_type("SRC1").alias("by_source"), lexical.match_type("able").alias("by_text"))


@query(f"""WITH {_PAPERS_SQL}, a AS (SELECT paper_id, abstract, strpos(lower(abstract), 'ntble') - 1 AS i FROM p),
b AS (SELECT paper_id, abstract, i, greatest(0, i - 80) AS s, least(length(abstract), i + 205) AS e FROM a)
SELECT paper_id, CASE WHEN i < 0 THEN substr(abstract, 1, 300) ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || regexp_replace(substr(abstract, s + 1, e - s), '(?i)ntble', '**\\0**', 'g') || (CASE WHEN e < length(abstract) THEN '...' ELSE '' END) END AS preview FROM b""")
def highlights(spark, sf_dir):
    return doc_papers(spark, sf_dir).select("paper_id", lexical.highlight(F.col("abstract"), "ntble").alias("preview"))


_TEXTS = ("title", "abstract", "summary")


def _found_sql(t: str, fields: tuple[str, ...] = _TEXTS) -> str:
    return " + ".join(f"(length({c}) - length(replace(lower({c}), '{t}', ''))) // {len(t)}" for c in fields)


def _bm25_sql(counts: list[str], where: str | None = None, counting: list[str] | None = None) -> str:
    """Ranks of the papers by the counts f0, f1, ... (terms, or SQL for the number of times they
    occur) where the condition holds; counting: what enters the rank in place of the counts."""
    counts = [c if " " in c else _found_sql(c) for c in counts]
    counting = counting or [f"f{k}" for k in range(len(counts))]
    stats = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(counts)))
    idf = lambda k: f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END"
    rank = " - ".join(["0.0", *(f"({idf(k)}) * ({f}) * 2.2 / (({f}) + 1.2 * (0.25 + 0.75 * d / ad))" for k, f in enumerate(counting))])
    return f"""{_PAPERS_SQL}, c AS (SELECT *, greatest(length(title) - 2, 0) + greatest(length(abstract) - 2, 0) + greatest(length(summary) - 2, 0) AS d, {", ".join(f"{x} AS f{k}" for k, x in enumerate(counts))} FROM p),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(d) AS ad, {stats} FROM c),
r AS (SELECT paper_id, {rank} AS rank FROM c, st WHERE {where or " AND ".join(f"f{k} > 0" for k in range(len(counts)))})"""


@query(f"WITH {_bm25_sql(['thwhwh', 'onthe'])} SELECT paper_id, round(rank, 6) AS rank FROM r")
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, "thwhwh onthe")


@query(f"""WITH {_bm25_sql(['thwhwh'])}, l AS (SELECT paper_id, {_like_sql('thwhwh')} AS base FROM p WHERE {_like_sql('thwhwh')} > 0 ORDER BY base DESC, title, paper_id LIMIT 20),
f AS (SELECT paper_id, rank FROM r ORDER BY rank, paper_id LIMIT 20),
m AS (SELECT paper_id, greatest(base, 15 - (rank + 1)) AS score, row_number() OVER (ORDER BY base DESC NULLS LAST, p.title, paper_id) AS la, rank FROM l FULL JOIN f USING (paper_id) JOIN p USING (paper_id))
SELECT paper_id, round(score, 1) AS score FROM m ORDER BY m.score DESC, CASE WHEN m.score IS NULL THEN 1 ELSE 0 END, la LIMIT 10""")
def hybrid_search(spark, sf_dir):
    index = doc_index(spark, sf_dir)
    return lexical.search(index.papers, "thwhwh", 10, index).select("paper_id", F.col("score").cast("double").alias("score"))


_EITHER = "CASE WHEN f0 > 0 AND f1 > 0 THEN f{k} ELSE 0 END"


@query(f"WITH {_bm25_sql(['thwhwh', 'onthe', 'leenè', 'erly'], '(f0 > 0 AND f1 > 0) OR (f2 > 0 AND NOT f3 > 0)', [_EITHER.format(k=0), _EITHER.format(k=1), 'CASE WHEN f3 > 0 THEN 0 ELSE f2 END', '0'])} SELECT paper_id, round(rank, 6) AS rank FROM r")
def bm25_boolean(spark, sf_dir):
    return _bm25(spark, sf_dir, 'thwhwh AND onthe* OR "leenè" NOT erly')


_BODY = ("title", "abstract")


@query(f"WITH {_bm25_sql([_found_sql('erly', _BODY), _found_sql('thwhwh', _BODY), _found_sql('onthe', _BODY), _found_sql('src1 ', ('summary',))], '(f0 > 0 OR f1 > 0) AND f2 > 0 AND NOT f3 > 0', ['f0', 'f1', 'f2', '0'])} SELECT paper_id, round(rank, 6) AS rank FROM r")
def bm25_grouped(spark, sf_dir):
    """Parentheses and column filters, given and excluded."""
    return _bm25(spark, sf_dir, '{title abstract}:(erly OR thwhwh) AND -summary:onthe NOT summary:"src1 "')


_STARTS = " + ".join(f"CAST(starts_with(lower({c}), 'anh') AS INTEGER)" for c in _TEXTS)


@query(f"WITH {_bm25_sql([_STARTS, 'onthe', 'thwhwh'], 'f0 > 0 OR (f1 > 0 AND f2 > 0)', ['f0', 'CASE WHEN f2 > 0 THEN f1 ELSE 0 END', 'CASE WHEN f1 > 0 THEN f2 ELSE 0 END'])} SELECT paper_id, round(rank, 6) AS rank FROM r")
def bm25_anchored(spark, sf_dir):
    """A phrase at the start of a field; strings joined by +, which overlap in two characters."""
    return _bm25(spark, sf_dir, "^anh OR (ont + nthe AND thwhwh)")


def _places_sql(t: str) -> str:
    """Where t starts in the fields that have both texts; t does not overlap itself."""
    return f"(SELECT paper_id, c, sum(length(part)) OVER (PARTITION BY paper_id, c ORDER BY i) + (i - 1) * {len(t)} AS at FROM (SELECT paper_id, c, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM (SELECT paper_id, c, string_split(x, '{t}') AS parts FROM both_in)) QUALIFY i < n)"


_NEAR = f"""both_in AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT paper_id, '{c}' AS c, lower({c}) AS x FROM p" for c in _TEXTS)}) WHERE contains(x, 'ther') AND contains(x, 'onthe')),
near AS (SELECT paper_id, count(DISTINCT a.c || a.at) AS m0, count(DISTINCT b.c || b.at) AS m1 FROM {_places_sql("ther")} a JOIN {_places_sql("onthe")} b USING (paper_id, c) WHERE a.at <= b.at AND b.at - a.at <= 42 OR b.at < a.at AND a.at - b.at <= 43 GROUP BY paper_id)"""


@query(f"WITH {_bm25_sql(['ther', 'onthe'], 'true', ['m0', 'm1']).replace(', c AS', f', {_NEAR}, c AS').replace('FROM c, st', 'FROM c JOIN near USING (paper_id), st')} SELECT paper_id, round(rank, 6) AS rank FROM r")
def bm25_near(spark, sf_dir):
    """Phrases within a distance; only the places that are near count."""
    return _bm25(spark, sf_dir, "NEAR(ther onthe, 40)")


_WHOLE = "CASE WHEN regexp_matches(lower({x}), '(^|[^\\p{{L}}\\p{{N}}_])erly([^\\p{{L}}\\p{{N}}_]|$)') THEN '{c}' END"


@query(f"""WITH {_bm25_sql(["erly"])}, l AS (SELECT paper_id, {_like_sql("erly")} AS base FROM p WHERE {_like_sql("erly")} > 0 ORDER BY base DESC, title, paper_id LIMIT 30),
f AS (SELECT paper_id, rank, row_number() OVER (ORDER BY rank, paper_id) AS fa FROM r ORDER BY rank, paper_id LIMIT 30),
m AS (SELECT p.*, greatest(base, 15 - (rank + 1)) AS score, CASE WHEN base IS NOT NULL THEN row_number() OVER (ORDER BY base DESC NULLS LAST, p.title, p.paper_id) END AS la, fa FROM l FULL JOIN f USING (paper_id) JOIN p USING (paper_id)),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, la NULLS LAST, fa NULLS LAST) AS place, strpos(lower(abstract), 'erly') - 1 AS i FROM m QUALIFY place <= 20),
w AS (SELECT *, greatest(0, i - 80) AS s, least(length(abstract), i + 204) AS e FROM t),
h AS (SELECT *, CASE WHEN i < 0 THEN substr(abstract, 1, 300) ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || regexp_replace(substr(abstract, s + 1, e - s), '(?i)erly', '**\\0**', 'g') || (CASE WHEN e < length(abstract) THEN '...' ELSE '' END) END AS abstract_preview FROM w),
k AS (SELECT *, coalesce(nullif(concat_ws('+', {_WHOLE.format(x="title", c="title")}, {_WHOLE.format(x="replace(abstract_preview, '**', '')", c="abstract")}, {_WHOLE.format(x="summary", c="summary")}), ''), 'unknown') AS match_type FROM h)
SELECT CAST(row_number() OVER (ORDER BY match_type <> 'unknown' DESC, place) AS INTEGER) AS position, paper_id, title, filename, abstract_preview, summary, match_type, round(score, 1) AS score FROM k""")
def short_query_search(spark, sf_dir):
    """Substring hits stay after whole-word hits."""
    index = doc_index(spark, sf_dir)
    return lexical.search(index.papers, "erly", 20, index)


# ---- vectors ----

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY {_COS} DESC, b.vec_id LIMIT 20")
def knn_single(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.filter("vec_id = 7").first()
    return vector.nearest(vectors, q["embedding"], 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10")
def knn_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector.nearest_batch(vectors, vectors.filter("vec_id % 20 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_vectors: dict[tuple[str, str], vector.Index] = {}


@query()
def knn_ivf(spark, sf_dir):
    """knn_batch by an index of every vector that is written once in a session."""
    vectors, key = table(spark, sf_dir, "embeddings"), (spark.sparkContext.applicationId, sf_dir)
    if key not in _vectors:
        folder = session_dir(spark, "vectors")
        vector.write_index(vectors, folder)
        _vectors[key] = vector.Index(spark, folder)
    return _vectors[key].nearest_batch(vectors.filter("vec_id % 20 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT b.vec_id, b.label, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.label = a.label ORDER BY {_COS} DESC, b.vec_id LIMIT 15")
def knn_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.filter("vec_id = 7").first()
    same = vectors.filter(F.col("label") == q["label"])
    return vector.nearest(same, q["embedding"], 15).join(same.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH h AS (SELECT b.vec_id, {_COS} AS c FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY c DESC, b.vec_id LIMIT 20) SELECT vec_id, round(1 / (1 + exp(-8 * c)), 6) AS score FROM h ORDER BY c DESC, vec_id LIMIT 5")
def rerank_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    near = vector.nearest(vectors, vectors.filter("vec_id = 7").first()["embedding"], 20)
    hits = near.select("vec_id", F.col("score").alias("query"), F.lit(8.0).alias("text"))
    return vector.rerank(hits, 5, lambda a, b: a * b, ties=("vec_id",)).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(1 / (1 + exp(-10 * CAST(embedding[1] AS DOUBLE))), 6) AS p FROM embeddings")
def sigmoid_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(T.sigmoid(10 * F.col("embedding")[0].cast("double")), 6).alias("p"))


@query(ORACLE_SQL["chunk_words"].replace("SELECT doc_id, CAST(row_number()", "SELECT doc_id, chunk_index, CASE WHEN length(chunk_text) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM (SELECT doc_id, CAST(row_number()") + ")")
def embed_chunks(spark, sf_dir):
    chunks = chunk.chunk_documents(documents(spark, sf_dir), "doc_id")
    embedded = vector.embed(chunks, lambda: vector.trigram_encoder(64))
    return embedded.select("doc_id", "chunk_index", F.round(vector.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query()
def latent_search(spark, sf_dir):
    """The documents nearest to the text of document 7 by an encoder trained on all of them."""
    docs = documents(spark, sf_dir)
    counted = cut(semantic.count(docs.select("doc_id", "text")))
    shared = spark.sparkContext.broadcast(semantic.fit_counted(counted))
    wanted = shared.value([docs.filter("doc_id = 7").agg(F.min("text")).first()[0]])[0]
    return vector.nearest(semantic.encode(counted, lambda: shared.value), wanted.tolist(), 20, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


# ---- chunks of papers: conversations and their turns ----


@query("SELECT conv_id, turn, role FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 800")
def fulltext_prefix(spark, sf_dir):
    return chunk.text_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 800).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS n_chunks, string_agg(text, ' ' ORDER BY turn, text) AS full_text FROM conversations GROUP BY conv_id")
def paper_concat(spark, sf_dir):
    return chunk.concat_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, substr(string_agg('[' || turn || '] (' || role || ') ' || text, chr(10) || chr(10) ORDER BY turn, role, text), 1, 100000) AS dump FROM conversations GROUP BY conv_id")
def fulltext_dump(spark, sf_dir):
    return chunk.numbered_dump(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1 AS is_first, substr(role || ' ' || text, 1, 30) AS section, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS preview FROM conversations")
def hit_grouping(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.struct(-F.length("text"), "turn").alias("position"), F.concat_ws(" ", "role", "text").alias("section"))
    return papers.grouped_hits(hits, "conv_id").select("conv_id", "turn", "is_first", "section", "preview")


def _conversation_chunks(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("chunk_index"), F.when(F.col("turn") == 0, F.concat(F.lit("ABSTRACT "), "text", F.lit(" KEYWORDS x."))).otherwise(F.col("text")).alias("text"), F.concat(F.lit("t"), "conv_id").alias("title"))


_BUILT = rf"""
t AS (SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN 'ABSTRACT ' || text || ' KEYWORDS x.' ELSE text END, ' ' ORDER BY turn, text) AS full_text, trim(regexp_replace(regexp_replace(max(text) FILTER (turn = 0), '\s+', ' ', 'g'), '([\p{{L}}\p{{N}}_])-\s([\p{{L}}\p{{N}}_])', '\1\2', 'g')) AS own FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, full_text, CAST(length(trim(full_text)) >= 50 AND length(own) >= 40 AS INTEGER) AS has_abstract, CASE WHEN length(trim(full_text)) < 50 THEN '' WHEN length(own) >= 40 THEN own ELSE trim(substr(array_to_string(list_slice({_WORDS_SQL.format(x="full_text")}, 1, 100), ' '), 1, 500)) END AS abstract FROM t),
o AS (SELECT conv_id, CASE WHEN length(abstract) >= 30 THEN abstract ELSE array_to_string(list_filter(string_split(substr(full_text, 1, 5000), chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '{_BOILER}')), chr(10)) END AS source FROM a),
s AS (SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(source, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format(x="x")}), lambda x: x <> '') AS ss FROM o),
u AS (SELECT conv_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM s),
b AS (SELECT conv_id, x, i, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
p AS (SELECT CAST(a.conv_id AS VARCHAR) AS paper_id, 't' || a.conv_id AS title, '' AS filename, 'papers' AS source, '' AS doi, '' AS authors, '' AS journal, '' AS collections, '' AS zotero_key, abstract, coalesce(y.summary, '') AS summary, CAST(length(abstract) AS INTEGER) AS abstract_len, has_abstract
FROM a LEFT JOIN (SELECT conv_id, string_agg(x, ' ' ORDER BY i) AS summary FROM b WHERE before < 200 GROUP BY conv_id) y USING (conv_id))"""


@query(f"WITH {_BUILT} SELECT * FROM p")
def build_papers(spark, sf_dir):
    return papers.papers_of(_conversation_chunks(spark, sf_dir))


@query(f"WITH {_BUILT} SELECT count(*) AS total, count(*) FILTER (has_abstract = 1) AS with_abstract, count(*) FILTER (has_abstract = 0 AND abstract_len > 0) AS fallback, count(*) FILTER (abstract_len = 0) AS empty, 100.0::DOUBLE * count(*) FILTER (has_abstract = 1) / greatest(count(*), 1) AS percent FROM p")
def build_stats(spark, sf_dir):
    return papers.build_stats(papers.papers_of(_conversation_chunks(spark, sf_dir)))


_KEYWORDS_SQL = r"""
w AS (SELECT doc_id, unnest(regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[a-zA-Z]+')) AS x, generate_subscripts(regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[a-zA-Z]+'), 1) AS i FROM documents),
k AS (SELECT lower(x) AS keyword, count(*) AS n, min(doc_id * 1000000 + i) AS first FROM w WHERE length(x) > 2 GROUP BY 1)"""


@query(f"WITH {_KEYWORDS_SQL} SELECT keyword, n FROM k ORDER BY n DESC, first LIMIT 10")
def keywords_topk(spark, sf_dir):
    return papers.keywords(doc_papers(spark, sf_dir), 10, "title", "paper_id")


@query(f"""WITH {_KEYWORDS_SQL}, t AS (SELECT keyword, row_number() OVER (ORDER BY n DESC, first) AS r FROM k),
a AS (SELECT string_agg(keyword, ', ' ORDER BY r) FILTER (r <= 5) AS top5, string_agg(keyword, ',' ORDER BY r) FILTER (r <= 10) AS keywords FROM t)
SELECT 'My Paper Collection' AS name, 'A collection of ' || c || ' academic papers covering topics related to ' || top5 || '.' AS description, c AS paper_count, c AS chunk_count, keywords, 'en' AS language FROM a, (SELECT count(*) AS c FROM documents)""")
def collection_info(spark, sf_dir):
    titles = doc_papers(spark, sf_dir)
    info = papers.collection_info(titles, titles.count(), place="paper_id")
    return info.withColumn("keywords", F.array_join("keywords", ","))


# ---- catalog ----


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS s FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) <= 3 THEN string_agg(s, '; ' ORDER BY l_linenumber, s) ELSE array_to_string(list_slice(list(s ORDER BY l_linenumber, s), 1, 3), '; ') || ' et al.' END AS authors FROM o GROUP BY l_orderkey""")
def ordered_list_etal(spark, sf_dir):
    return catalog.ordered_names(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], F.concat(F.lit("s"), "l_suppkey"))


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier),
t AS (SELECT id, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.name FROM n JOIN t ON n.parent = t.id) SELECT id, path FROM t""")
def recursive_path(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    tag = lambda x, c: F.concat(F.lit(x), c)
    nodes = r.select(tag("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.unionByName(n.select(tag("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), tag("r", "n_regionkey").alias("parent")))
    return catalog.paths(nodes.unionByName(s.select(tag("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), tag("n", "s_nationkey").alias("parent"))))


@query("SELECT p_partkey AS itemID, coalesce(p_name, '') AS title, '' AS abstract_note, coalesce(p_brand, '') AS doi, '' AS journal, '' AS date, coalesce(p_type, '') AS url FROM part")
def eav_pivot(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(i).alias("fieldID"), F.col(c).alias("value")) for i, c in ((1, "p_name"), (59, "p_brand"), (13, "p_type"), (99, "p_brand"))))).alias("f"))
    data = part.select(F.col("p_partkey").alias("itemID"), "f.fieldID", (F.col("p_partkey") * 100 + F.col("f.fieldID")).alias("valueID"), "f.value")
    return catalog.pivot_attributes(data.drop("value"), data.select("valueID", "value"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def anti_deleted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.not_deleted(table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 4000 OR o_totalprice > 200000 OR o_orderkey IN (1, 7)")
def incremental_scan(spark, sf_dir):
    return catalog.changed(table(spark, sf_dir, "orders"), 4000, 200000, spark.createDataFrame([(7,), (1,), (7,)], "o_orderkey long"), "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END, l_linenumber, l_partkey) = 1")
def first_attachment(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    return catalog.first_by(rows, "l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(2), F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT coalesce(max(o_orderkey), 0) AS high_water FROM orders")
def high_water(spark, sf_dir):
    return catalog.high_water(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT count(*) AS chunks, count(DISTINCT conv_id) AS papers FROM conversations")
def store_counts(spark, sf_dir):
    chunks = papers.paper_keys(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("paper_id")))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("paper_key").alias("papers"))


# ---- dedup, snapshots, layout, conversion, streams ----


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g') AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_id FROM t""")
def dedup_exact(spark, sf_dir):
    keyed = cut(documents(spark, sf_dir).select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), r"\s+", " "), 256).alias("k")))
    # the least id per text by partial aggregation, and a join that adaptive execution can split,
    # so a large group of copies is no hot task
    firsts = cut(keyed.groupBy("k").agg(F.min("doc_id").alias("first_id")))
    return keyed.join(firsts, "k").select("doc_id", "first_id")


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, {_TITLE} AS t, '10.1/' || CAST(floor(doc_id / 3.0) AS BIGINT) || lang AS d, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS ds, CAST(NULL AS BIGINT) AS doc_id, false AS accepted
UNION ALL SELECT n, CASE WHEN ok AND t <> '' THEN list_append(ts, t) ELSE ts END, CASE WHEN ok AND d IS NOT NULL THEN list_append(ds, d) ELSE ds END, doc_id, ok
FROM (SELECT k.n, k.doc_id, k.t, k.d, r.ts, r.ds, NOT (k.t <> '' AND list_contains(r.ts, k.t)) AND NOT coalesce(list_contains(r.ds, k.d), false) AS ok FROM r JOIN k ON k.n = r.n + 1))
SELECT doc_id, accepted FROM r WHERE n > 0""")
def dedup_greedy(spark, sf_dir):
    """Documents as items: two keys, the first line and a doi that a few share."""
    docs = documents(spark, sf_dir)
    items = docs.select("doc_id", T.normalize_title(F.substring_index("text", "\n", 1)).alias("title_norm"), F.concat(F.lit("10.1/"), F.floor(F.col("doc_id") / 3), F.col("lang")).alias("doi_norm"))
    return dedup.greedy(items, ["doi_norm", "title_norm"], "doc_id")


@query("WITH s AS (SELECT min(doc_id) AS store_id, k FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS k FROM documents WHERE doc_id % 2 = 0) WHERE k <> '' GROUP BY k) SELECT d.doc_id, coalesce(s.store_id, -1) AS store_id, CASE WHEN s.store_id IS NULL THEN 'insert' WHEN s.store_id = d.doc_id - 1 THEN 'update' ELSE 'skip_dup' END AS action FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS k FROM documents WHERE doc_id % 2 = 1) d LEFT JOIN s ON s.k = d.k")
def dedup_probe(spark, sf_dir):
    """Odd documents as new items against even ones as the store, by first line."""
    docs = documents(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("title_norm"), F.lit("").alias("doi_norm"))
    store = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("paper_id"), "doi_norm", "title_norm", (F.col("doc_id") + 1).alias("item_id"))
    found = dedup.decide(dedup.probe(docs.filter("doc_id % 2 = 1"), store), "doc_id")
    return found.select("doc_id", F.coalesce("existing_id", F.lit(-1)).alias("store_id"), "action")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version, coalesce(text, '') AS text FROM documents WHERE lang <> 'fr'")
def upsert_snapshot(spark, sf_dir):
    """Publish all documents, replace the English ones and delete the French ones in the buckets
    that have such, read back."""
    root = session_dir(spark, "papers")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    snapshot.publish(docs.withColumn("version", F.lit(1)), root, "doc_id")
    new = docs.filter("lang = 'en'").withColumn("version", F.lit(2))
    snapshot.update(new, docs.filter("lang = 'fr'").select("doc_id"), root, snapshot.manifest(spark, root))
    return snapshot.current(spark, root).select("doc_id", "version", "text")


@query("SELECT c_nationkey AS item, count(DISTINCT c_mktsegment) AS papers FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def removed_papers(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("item"), F.col("c_mktsegment").alias("paper_id"))
    gone = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"), F.when(F.col("n_regionkey") == 1, "x").alias("dateDeleted"))
    return snapshot.removed_papers(old, gone, "item")


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, trim(t, ' ' || chr(9) || chr(13)) AS t, i // 10 AS page, (i * 7) % 10 * 100 + 60 AS y, i FROM b),
k AS (SELECT doc_id, page, y, t FROM p WHERE page < 20 AND t <> '' AND y + 10 >= 50 AND y <= 950),
e AS (SELECT doc_id, page, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, page, sum(length(t)) AS n FROM k GROUP BY ALL))
SELECT d.doc_id, x.text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, chr(10) ORDER BY page, y) AS text FROM k JOIN e USING (doc_id, page) WHERE before <= 3000 GROUP BY doc_id) x USING (doc_id)""")
def layout_order(spark, sf_dir):
    """Lines as blocks, ten to a page, in a scrambled vertical order; the last falls in the footer
    band."""
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    y = (F.col("i") * 7 % 10 * 100 + 60).cast("double")
    blocks = lines.select("doc", F.floor(F.col("i") / 10).alias("page"), F.lit(0).alias("type"), F.lit(50.0).alias("x0"), y.alias("y0"), (y + 10).alias("y1"), F.lit(1000.0).alias("height"), "text")
    return layout.page_text(blocks, soft_chars=3000).select(F.col("doc").alias("doc_id"), "text")


@query("SELECT 'img' || doc_id || '.png' AS name FROM documents WHERE doc_id % 3 <> 0")
def orphan_images(spark, sf_dir):
    docs = documents(spark, sf_dir)
    images = docs.select(F.concat(F.lit("img"), "doc_id", F.lit(".png")).alias("name"))
    pages = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("![x](images/img"), "doc_id", F.lit(".png) "), "text").alias("markdown"))
    return convert.orphan_images(images, pages)


@query("SELECT doc_id, doc_id % 7 <> 3 AS success, CASE WHEN doc_id % 7 <> 3 THEN length(coalesce(text, '')) ELSE 0 END AS chars FROM documents")
def batch_convert(spark, sf_dir):
    def converter(path: str, content: bytes, options: dict) -> str:
        if int(path.split(".")[0]) % 7 == 3:
            raise ValueError("damaged")
        return content.decode()

    files = documents(spark, sf_dir).select(F.concat("doc_id", F.lit(".pdf")).alias("path"), F.col("doc_id").cast("string").alias("output_name"), F.col("text").cast("binary").alias("content"))
    return convert.convert(files, converter).select(F.col("output_name").cast("long").alias("doc_id"), "success", F.length("markdown").cast("long").alias("chars"))


@query("SELECT s_suppkey, 'Page of ' || coalesce(s_name, '') AS text FROM supplier")
def markdown_folder(spark, sf_dir):
    """A folder of files for each supplier: the page with the image that it shows, and not the one
    that it does not; read back."""
    folder = session_dir(spark, "files")
    name = F.col("s_suppkey").cast("string")
    page = F.concat(F.lit("# Page of "), F.coalesce("s_name", F.lit("")), F.lit("\n\n![](images/"), name, F.lit(".png)"))
    pictures = F.transform(F.array(name, F.concat(name, F.lit("-unseen"))), lambda n: F.struct(F.concat(n, F.lit(".png")).alias("name"), n.cast("binary").alias("content")))
    rows = table(spark, sf_dir, "supplier").select(name.alias("output_name"), F.lit(True).alias("success"), page.alias("markdown"), pictures.alias("images"))
    markdown_files.write(rows, folder, "images")
    return folders.markdown(spark, folder).select(T.stem(F.col("path")).cast("long").alias("s_suppkey"), "text")


@query("SELECT count(*) AS rows, true AS near FROM documents WHERE lang IS DISTINCT FROM 'fr'")
def store_statistics(spark, sf_dir):
    """The counted rows of a store of whole documents after the French ones were deleted, and
    whether the estimate of distinct keys is within 5 % of their exact number."""
    root, docs = session_dir(spark, "counted"), documents(spark, sf_dir).select("doc_id", "lang", "text")
    snapshot.publish(docs, root, "doc_id")
    snapshot.update(docs.limit(0), docs.filter("lang = 'fr'").select("doc_id"), root, snapshot.manifest(spark, root))
    found = snapshot.statistics(spark, root, snapshot.manifest(spark, root))
    exact = docs.filter("lang is distinct from 'fr'").agg(F.count_distinct("doc_id").alias("exact"))
    return found.join(exact).select("rows", (F.abs(F.col("doc_id") - F.col("exact")) <= F.col("exact") * 0.05).alias("near"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_incremental(spark, sf_dir):
    """Micro-batches of events add their partial sums to a table; the sums of those are the
    result."""
    root = session_dir(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{root}/sums/batch={number}")

    drive(stream, batch, f"{root}/checkpoint").awaitTermination()
    sums = spark.read.schema("event_type string, n long, total double").parquet(f"{root}/sums")
    return sums.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


__all__ = ["ORACLE_SQL", "QUERIES", "cut"]
