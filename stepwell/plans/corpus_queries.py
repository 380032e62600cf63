"""Queries of the corpus, reading, selection and layout rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwell.functions import steps as sf
from stepwell.functions import text as tx
from stepwell.operators import corpus, quality, search, signals
from stepwell.plans.encoding import TRACE_SQL, table, trace
from stepwell.plans.feature_queries import KINDS, RC_SQL
from stepwell.plans.relational_queries import LINES, PAIRS, RUN, _pairs, _run

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- papers: links, pages, addresses, scores -------------------------------------------

_HEAD = r"'# Top' || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE '## Part ' || (page_id % 5) || chr(10) END"
MARKDOWN = (
    "(SELECT page_id, " + _HEAD + r" || 'x [[Paper]](' || CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '//b.org/' || (page_id % 7) WHEN 2 THEN '://c.org/' || page_id ELSE 'd.org' END || ')'"
    r" || chr(10) || '## Late' || chr(10) || 'y [\[Paper\]](https://e.org/' || (page_id % 9) || ')' AS text FROM pages)"
)
_LINK = r"(?m)(^#{1,2}\s+.+$|\[\[?\\?Paper\\?\]?\]\([^)]+\))"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    part = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("## Part "), n % 5, F.lit("\n")))
    link = F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.lit("//b.org/"), n % 7)).when(n % 4 == 2, F.concat(F.lit("://c.org/"), n)).otherwise("d.org")
    text = F.concat(F.lit("# Top\n"), part, F.lit("x [[Paper]]("), link, F.lit(")\n## Late\ny [\\[Paper\\]](https://e.org/"), n % 9, F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


@query(
    rf"""WITH m AS (SELECT page_id, unnest(marks) AS mark, generate_subscripts(marks, 1) AS pos FROM (SELECT page_id, regexp_extract_all(text, '{_LINK}', 0) AS marks FROM {MARKDOWN})),
h AS (SELECT *, coalesce(last_value(CASE WHEN mark LIKE '## %' THEN substr(mark, 4) END IGNORE NULLS) OVER w, last_value(CASE WHEN mark LIKE '# %' THEN substr(mark, 3) END IGNORE NULLS) OVER w, '') AS section
 FROM m WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
u AS (SELECT page_id, pos, section, CASE WHEN starts_with(u, 'http') THEN u WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, ':/') THEN 'https' || u ELSE 'https://' || u END AS url
 FROM (SELECT *, regexp_extract(mark, '\(([^)]+)\)', 1) AS u FROM h WHERE NOT starts_with(mark, '#')))
SELECT page_id, url, section FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS r FROM u) WHERE r = 1"""
)
def paper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.paper_links(_markdown(spark, sf_dir), "page_id", "text")


@query(
    r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Title ' || page_id ELSE trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) END AS title,
 CASE page_id % 3 WHEN 0 THEN 'Short ' || page_id WHEN 1 THEN 'Long ' || page_id ELSE '' END AS abstract, CASE WHEN page_id % 4 = 0 THEN CAST(2000 + page_id % 24 AS VARCHAR) ELSE '' END AS year FROM pages"""
)
def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, abstracts and years of pages; some get the tags that papers' pages have."""
    n = F.col("page_id")
    title = F.when(n % 2 == 0, F.concat(F.lit('<meta name="citation_title" content="Title '), n, F.lit('">'))).otherwise("")
    quote = F.concat(F.lit("<blockquote class='abstract mathjax'>\n<span>Abstract:</span> Long <b>"), n, F.lit("</b></blockquote>"))
    abstract = F.when(n % 3 == 0, F.concat(F.lit("<META name='description' content='Short "), n, F.lit("'>"))).when(n % 3 == 1, quote).otherwise("")
    year = F.when(n % 4 == 0, F.concat(F.lit('<meta name="citation_date" content="'), 2000 + n % 24, F.lit('/05/01">'))).otherwise("")
    html = F.concat(title, abstract, year, F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", tx.html_title(html).alias("title"), tx.html_abstract(html).alias("abstract"), tx.html_year(html).alias("year"))


@query(
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://arxiv.org/pdf/2101.' || n || '.pdf' WHEN 1 THEN 'https://openreview.net/pdf?id=' || n
 WHEN 2 THEN 'https://proceedings.neurips.cc/paper_files/paper/2023/file/ab' || n || '-Paper-Conference.pdf' WHEN 3 THEN 'https://proceedings.mlr.press/v1/' || n || '.pdf'
 WHEN 4 THEN 'https://aclanthology.org/' || n || '.pdf' WHEN 5 THEN 'https://x.org/' || n || '.PDF' WHEN 7 THEN 'https://openreview.net/pdf?id=' || n END AS pdf,
 CASE page_id % 8 WHEN 0 THEN '2101_' || n ELSE 'a_b_' || n END AS slug, page_id % 8 IN (0, 1, 2, 3, 4, 7) AS easy FROM (SELECT page_id, 10000 + page_id AS n FROM pages)"""
)
def pdf_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = 10000 + F.col("page_id"), F.col("page_id") % 8
    say = lambda a, b="": F.concat(F.lit(a), n, F.lit(b))
    url = (
        F.when(kind == 0, say("https://arxiv.org/abs/2101.", "v2")).when(kind == 1, say("https://openreview.net/forum?id="))
        .when(kind == 2, say("https://proceedings.neurips.cc/paper_files/paper/2023/hash/ab", "-Abstract-Conference.html"))
        .when(kind == 3, say("https://proceedings.mlr.press/v1/", ".html")).when(kind == 4, say("https://aclanthology.org/", "/"))
        .when(kind == 5, say("https://x.org/", ".PDF")).when(kind == 6, say("https://x.org/")).otherwise(say("https://openreview.net/pdf?id="))
    )
    number = tx.arxiv_id(url)
    slug = tx.slug(number, F.concat(F.lit("A: (b)  "), n))
    return table(spark, sf_dir, "pages").select("page_id", tx.pdf_url(url).alias("pdf"), slug.alias("slug"), tx.easy_pdf(number, url).alias("easy"))


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Org/Repo' || c_nationkey WHEN 1 THEN 'own/rep_' || c_nationkey WHEN 2 THEN 'dataset:d' || c_nationkey
 WHEN 3 THEN 'dataset:q/d' || c_nationkey ELSE 'task:plain-' || c_custkey END AS codebase FROM customer"""
)
def codebase_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, nation, kind = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey") % 5
    url = F.when(kind == 0, F.concat(F.lit("https://g.example/Org/Repo"), nation, F.lit(".git")))
    bench = F.when(kind == 1, "swebench").when(kind == 2, "dab").when(kind == 3, "datamind").otherwise("other")
    task = F.when(kind == 1, F.concat(F.lit("own__rep_"), nation, F.lit("-"), n)).when(kind == 2, F.concat(F.lit("q__d"), nation)).when(kind == 3, F.concat(F.lit("q__d"), nation, F.lit("__x")))
    task = task.otherwise(F.concat(F.lit("plain-"), n))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.codebase_key(bench, task, url).alias("codebase"))


A, B, CONTEXT, OFF = ["the ", "sto"], ["pre", "ver"], ["an", "on"], ["zz", "qu", "ix"]
_COUNT = lambda words: "(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


@query(f"SELECT doc_id, (a >= 1 OR b >= 1) AND ctx >= 1 AND (o <= 2 OR a + b >= 2) AS keep FROM (SELECT doc_id, {_COUNT(A)} AS a, {_COUNT(B)} AS b, {_COUNT(CONTEXT)} AS ctx, {_COUNT(OFF)} AS o FROM documents)")
def keep_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [tx.keyword_hits(F.lower("text"), words) for words in (A, B, CONTEXT, OFF)]
    return table(spark, sf_dir, "documents").select("doc_id", tx.keep_rule(*hits).alias("keep"))


@query(r"SELECT doc_id, sha256(substr(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), 1, 4500)) AS slice FROM documents")
def concise_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short form of a document: by definition its first 4,500 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.concise(F.col("text")), 256).alias("slice"))


@query("SELECT name, source, nation, balance, cited FROM (SELECT c_name AS name, 'evolve' AS source, c_nationkey AS nation, c_acctbal AS balance, 0 AS cited FROM customer WHERE c_name <> '' UNION ALL SELECT s_name, 'cost', s_nationkey, NULL, s_suppkey FROM supplier WHERE s_name <> '')")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pools under one set of columns, tagged by their source; rows without a title are left out."""
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("evolve").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("cost").alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("cited"))
    both = a.unionByName(b, allowMissingColumns=True).filter(F.coalesce("name", F.lit("")) != "")
    return both.select("name", "source", "nation", "balance", F.coalesce("cited", F.lit(0)).alias("cited"))


@query(
    """SELECT o_custkey, list_reduce(list(q ORDER BY o_orderkey), lambda acc, q: CASE WHEN contains(acc, q) THEN acc ELSE acc || ' | ' || q END) AS queries
 FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS q FROM orders) GROUP BY o_custkey"""
)
def merged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merged_queries(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT doc_id, n_chars FROM documents ORDER BY CASE source WHEN 'web' THEN 0 WHEN 'wiki' THEN 1 WHEN 'code' THEN 2 ELSE 9 END, n_chars DESC, doc_id LIMIT 30")
def note_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of a report: by tier, then the longest note, then the name."""
    tier = F.when(F.col("source") == "web", 0).when(F.col("source") == "wiki", 1).when(F.col("source") == "code", 2).otherwise(9)
    return table(spark, sf_dir, "documents").orderBy(tier, F.desc("n_chars"), "doc_id").limit(30).select("doc_id", "n_chars")


# --- reading ----------------------------------------------------------------------------


@query(
    f"""WITH l AS ({LINES}), r AS (SELECT DISTINCT path, total, CASE path % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN greatest(1, total - 1) WHEN 3 THEN 2 ELSE 1 END AS lo,
 least(CASE path % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN total WHEN 3 THEN total ELSE 50 END, total) AS hi FROM l)
SELECT path, string_agg(CASE WHEN path % 2 = 0 THEN lpad(CAST(line_no AS VARCHAR), CAST(len(CAST(l.total AS VARCHAR)) AS INTEGER), ' ') || chr(9) || line ELSE line END, chr(10) ORDER BY line_no) AS text
FROM r LEFT JOIN (SELECT * FROM l) l USING (path) WHERE line_no BETWEEN lo AND hi OR NOT EXISTS (SELECT 1) GROUP BY path"""
)
def multi_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of all documents: two lines, a head, a tail, an open end, or the first fifty; every second one numbered."""
    lines = search.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    none, kind = F.lit(None).cast("int"), F.col("doc_id") % 5
    entry = F.struct(
        F.when(kind == 0, "2-3").alias("lines"), F.when(kind == 1, 2).alias("head"), F.when(kind == 2, 2).alias("tail"),
        F.when(kind == 3, 2).alias("start"), none.alias("end"), F.when(F.col("doc_id") % 2 == 0, True).alias("number"),
    )
    shared = F.struct(F.lit(None).cast("string").alias("lines"), *[none.alias(c) for c in ("head", "tail", "start", "end")], F.lit(False).alias("number"))
    asked = corpus.resolved_request(entry, shared)
    total = F.size(F.split("text", "\n"))
    first, last = sf.read_request(*[asked[c] for c in ("lines", "head", "tail", "start", "end")], total)
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("req"), F.col("doc_id").alias("path"), first.alias("first"), last.alias("last"), asked["number"].alias("numbered"))
    return corpus.multi_read(lines, requests).filter("text IS NOT NULL").select("path", "text")


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '... [' || (length(text) - 200) || ' characters cut]' ELSE text END) AS shown FROM documents")
def truncated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs over a limit, cut with a notice."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(sf.truncate_output(F.col("text"), 200), 256).alias("shown"))


@query("SELECT doc_id, sha256(CASE WHEN instr(text, 'e') > 0 THEN substr(text, 1, instr(text, 'e') - 1) || '<E>' || substr(text, instr(text, 'e') + 1) ELSE text END) AS edited FROM documents")
def first_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.replace_first(F.col("text"), F.lit("e"), F.lit("<E>")), 256).alias("edited"))


@query("SELECT l_orderkey, count(*) AS n, bool_or(l_tax > 0.05) AS slow FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber >= 6) = 0")
def unretried_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without an item that stands for a passing error (status 500 and up from line 6 on)."""
    again = sf.transient_error(F.lit("Error"), F.when(F.col("l_linenumber") >= 6, 500).otherwise(404))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_tax") > 0.05).alias("slow"), F.count_if(again).alias("again"))
    return rows.filter("again = 0").select("l_orderkey", "n", "slow")


# --- selection, order, layouts ------------------------------------------------------------

PATHS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'src/.git/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'a.egg-info/' WHEN 3 THEN 'src/build/' ELSE 'src/' END || p_brand || '/query' || p_size AS path FROM part"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 6
    folder = F.when(kind == 0, "src/.git/").when(kind == 1, "node_modules/").when(kind == 2, "a.egg-info/").when(kind == 3, "src/build/").otherwise("src/")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(folder, F.col("p_brand"), F.lit("/query"), F.col("p_size")).alias("path"))


# Folders that walks leave out.
SKIPPED = [".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", ".tox", ".eggs", "*.egg-info"]


@query(f"SELECT p_partkey, path FROM ({PATHS}) WHERE p_partkey % 6 > 3")
def pruned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pruned(_paths(spark, sf_dir), "path", SKIPPED).select("p_partkey", "path")


@query(f"SELECT p_partkey, path FROM ({PATHS}) WHERE contains(path, 'Brand#1')")
def path_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task that no case name holds is looked for in the paths."""
    rows = _paths(spark, sf_dir).withColumn("case", F.lit("case"))
    return corpus.task_filter(rows, "case", "path", "Brand#1").select("p_partkey", "path")


@query("SELECT o_orderkey FROM orders WHERE contains(o_orderpriority, '1-URGENT')")
def task_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("path", F.lit("x"))
    return corpus.task_filter(rows, "o_orderpriority", "path", "1-URGENT").select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey <= 3)")
def allowed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose dataset is on a list; the list here is the brands of the first three parts."""
    rows = table(spark, sf_dir, "part")
    allowed = [r.p_brand for r in rows.filter("p_partkey <= 3").select("p_brand").collect()]  # three rows
    return rows.filter(F.col("p_brand").isin(allowed)).select("p_partkey", "p_type")


@query(f"SELECT path, row_number() OVER (ORDER BY CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 4 > 0 THEN p_partkey END, CASE WHEN p_partkey % 4 = 0 THEN 'x' || p_partkey END) AS pos FROM (SELECT p_partkey, 'query' || CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END || p_partkey AS path FROM part) ORDER BY pos LIMIT 40")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty names by number, then by text."""
    name = F.concat(F.lit("query"), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(""), F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select(name.alias("path"))
    top = corpus.limited(rows.orderBy(*corpus.natural_key(F.col("path"), "query")), 40)
    pos = F.row_number().over(Window.orderBy(*corpus.natural_key(F.col("path"), "query"))).cast("bigint")
    return top.select("path", pos.alias("pos"))


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_name LIMIT 16)")
def first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_name").limit(16).select("c_custkey")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation in the order in which they first speak."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "role")))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ">").alias("roles"))


@query("SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus IN ('F', 'O')) AS BIGINT) AS passed, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS rejected FROM orders GROUP BY 1")
def batch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(status.isin("F", "O")).alias("passed"), F.count_if(status == "P").alias("rejected"))


@query("SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT ALL SELECT DISTINCT c_nationkey FROM customer)) + (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT ALL SELECT n_nationkey FROM nation)) = 0 AS equal")
def lists_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select("n_nationkey")
    return corpus.same_rows(a, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct())


@query("SELECT coalesce(a.c_custkey, b.k) AS c_custkey, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.c_acctbal END AS balance FROM customer a FULL JOIN (SELECT o_custkey AS k, CAST(max(o_totalprice) AS DOUBLE) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) b ON a.c_custkey = b.k")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"))
    return corpus.upsert(old, new, "c_custkey", "balance")


@query("SELECT o_orderkey, 'run/t' || o_custkey || '/agent/trajectory.json' AS trajectory FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 > 0")
def result_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beside the trajectory in the folder of the same trial."""
    results = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("run/t"), F.col("o_custkey"), F.lit("/result.json")).alias("path"))
    trajectories = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.concat(F.lit("run/t"), F.col("c_custkey"), F.lit("/agent/trajectory.json")).alias("trajectory"))
    trial = lambda c, tail: F.regexp_replace(c, tail, "")
    return results.withColumn("trial", trial("path", "/result.json$")).join(trajectories.withColumn("trial", trial("trajectory", "/agent/trajectory.json$")), "trial").select("o_orderkey", "trajectory")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def layout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return corpus.layout_gaps(table(spark, sf_dir, "customer"), existing, "c_custkey")


@query("SELECT max(CASE WHEN o_custkey % 1000003 = 7 THEN 1 ELSE 0 END) = 0 AS complete FROM orders")
def covered_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was processed is what was due, in order; here one customer's cases came out as others."""
    due = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case"))
    done = due.withColumn("case", F.when(F.col("case") % 1000003 == 7, -1).otherwise(F.col("case")))
    return corpus.coverage_in_order(due, done, "o_orderkey", "case")


@query(f"SELECT count(*) AS leaks FROM ({PATHS}) WHERE path LIKE '%/query7'")
def leaked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.leaks(_paths(spark, sf_dir), "path", "/query7$").agg(F.count("*").alias("leaks"))


@query("SELECT o_orderkey, o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AS complete FROM orders")
def complete_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials whose config and result both parse to objects."""
    key = F.col("o_orderkey")
    config, result = F.when(key % 3 > 0, '{"a": 1}').otherwise("[1]"), F.when(key % 5 > 0, '{"b": {}}').otherwise('{"b": ')
    whole = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", (whole(config) & whole(result)).alias("complete"))


@query("SELECT o_orderkey, sha256('{\"case\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\"}') AS identity FROM orders")
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.to_json(F.struct(F.col("o_custkey").alias("case"), F.col("o_orderstatus").alias("status"))), 256).alias("identity"))


@query("SELECT o_orderkey, 'own__case-' || o_custkey AS two_parts, 'own' AS first_part FROM orders")
def case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rules for a trial's case: the first two parts of its folder's name, or the first alone."""
    name = F.concat(F.lit("own__case-"), F.col("o_custkey"), F.lit("__run"), F.col("o_orderkey"))
    two, one = F.substring_index(name, "__", 2), F.substring_index(name, "__", 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", two.alias("two_parts"), one.alias("first_part"))


@query("SELECT o_orderkey, printf('%-15s%10d', o_orderpriority, o_custkey) AS line FROM orders")
def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%-15s%10d", "o_orderpriority", "o_custkey").alias("line"))


# --- costs and traces -----------------------------------------------------------------------


@query(PAIRS + ", n AS (" + RUN.format(f="N") + ") SELECT case_id, sa - n.steps AS a_less_n, sb - n.steps AS b_less_n FROM p JOIN n USING (case_id)")
def third_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that a third run has too."""
    n = _run(spark, sf_dir, "N").select("case_id", F.col("steps").alias("n"))
    return _pairs(spark, sf_dir).join(n, "case_id").select("case_id", (F.col("a_steps") - F.col("n")).alias("a_less_n"), (F.col("b_steps") - F.col("n")).alias("b_less_n"))


@query(PAIRS + "SELECT round(CAST(sum(CAST(round(CAST(ia AS DOUBLE) / nullif(sa - 1, 0), 6) AS DECIMAL(24,6))) AS DOUBLE) / count(nullif(sa - 1, 0)), 4) AS per_step, CAST(count(nullif(sa - 1, 0)) AS BIGINT) AS n FROM p")
def per_step_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean input of a step over cases, those without steps (here: beyond the first) left out."""
    steps = F.nullif(F.col("a_steps") - 1, F.lit(0))
    one = F.round(F.col("a_n_input").cast("double") / steps, 6).cast("decimal(24,6)")
    return _pairs(spark, sf_dir).agg(F.round(F.sum(one).cast("double") / F.count(steps), 4).alias("per_step"), F.count(steps).alias("n"))


@query(TRACE_SQL + "SELECT trial_id, CAST(count(*) FILTER (contains(cmd, 'git commit')) AS BIGINT) AS commits FROM trace GROUP BY 1 HAVING count(*) FILTER (contains(cmd, 'git commit')) >= 2")
def repeated_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = F.count_if(sf.bash_command(F.col("calls")).rlike(r"\bgit\s+commit\b"))
    return trace(spark, sf_dir).groupBy("trial_id").agg(commits.alias("commits")).filter("commits >= 2")


@query(
    KINDS
    + f""", f AS (SELECT *, {RC_SQL} AS rc, place AS file, sum(CASE WHEN kind = 'read' THEN 0 ELSE 1 END) OVER (PARTITION BY trial_id ORDER BY i) AS run FROM kinds),
g AS (SELECT *, count(*) FILTER (kind = 'read') OVER (PARTITION BY trial_id, run) AS n, CASE WHEN kind = 'read' AND file IS NOT NULL THEN row_number() OVER (PARTITION BY trial_id, file, kind ORDER BY i) ELSE 0 END AS nth FROM f)
SELECT trial_id, CAST(count(*) FILTER (coalesce(rc, 0) <> 0 AND NOT (v = 'grep' AND rc = 1)) AS BIGINT) AS wasted, CAST(count(*) FILTER (kind = 'read' AND (n >= 3 OR nth > 1)) AS BIGINT) AS redundant_reads,
 CAST(count(*) FILTER (contains(cmd, 'git commit')) >= 2 AS BOOLEAN) AS multi_commit FROM g GROUP BY trial_id"""
)
def cost_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = sf.bash_command(F.col("calls"))
    place = F.filter(F.transform("calls", lambda c: F.try_element_at(c["arguments"], F.lit("file_path"))), lambda x: x.isNotNull())
    rows = trace(spark, sf_dir).select("trial_id", "i", command.alias("command"), sf.op_type(command).alias("op_type"), sf.bash_verb(command).alias("verb"),
                                       sf.returncode(F.col("contents")).alias("rc"), F.lit("").alias("output"), place.alias("files"))
    flags = corpus.step_flags(rows)
    return flags.groupBy("trial_id").agg(
        F.count_if("is_wasted").alias("wasted"), F.count_if("is_redundant_read").alias("redundant_reads"), (F.count_if(F.col("command").contains("git commit")) >= 2).alias("multi_commit")
    )


@query(
    """SELECT p_brand, round(calls * (1 - failures / CAST(greatest(calls, 1) AS DOUBLE)) * (1 + saved / 1000.0) * CASE WHEN delta >= 0 THEN 1.0 ELSE 0.5 END, 6) AS score, calls < 5 OR cases < 2 AS dead
 FROM (SELECT p_brand, count(*) AS calls, count(*) FILTER (p_size < 10) AS failures, count(DISTINCT p_type) AS cases, CAST(sum(p_size) AS BIGINT) AS saved, CAST(max(p_size) AS BIGINT) - 49 AS delta FROM part GROUP BY 1)"""
)
def helper_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count("*").alias("calls"), F.count_if(F.col("p_size") < 10).alias("failures"), F.count_distinct("p_type").alias("cases"), F.sum("p_size").alias("saved"), (F.max("p_size") - 49).alias("delta")
    )
    dead = corpus.dead_helpers(stats, 5, 2).select("p_brand", F.lit(True).alias("dead"))
    score = F.round(corpus.helper_score(F.col("calls"), F.col("failures"), F.col("saved"), F.col("delta")), 6)
    return stats.join(dead, "p_brand", "left").select("p_brand", score.alias("score"), F.coalesce("dead", F.lit(False)).alias("dead"))


@query(
    TRACE_SQL
    + """SELECT trial_id, i // 4 AS part, string_agg('step  ' || i, chr(10) ORDER BY i) AS message, CAST(sum(n_calls) AS BIGINT) AS calls, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS merged_from
 FROM trace WHERE k % 3 <> 1 GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def merged_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a trajectory merged to one step each."""
    rows = trace(spark, sf_dir).withColumn("part", F.floor(F.col("i") / 4).cast("bigint")).withColumn("deps", F.array(F.lit(0)))
    members = signals.trajectory_slice(rows, rows.filter("k % 3 <> 1"))
    out = signals.merge_steps(members, ["trial_id", "part"]).filter(F.size("merged_from") >= 2)
    return out.select("trial_id", "part", "message", F.size("calls").cast("bigint").alias("calls"), F.array_join("merged_from", ",").alias("merged_from"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'bad_name' END, CASE WHEN p_partkey % 4 = 0 THEN 'unknown_required:c,d' END], lambda x: x IS NOT NULL), ';') AS issues FROM part")
def tool_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    name = F.when(n % 3 == 0, "Bad_Name").otherwise("good-name")
    required = F.when(n % 4 == 0, F.array(*map(F.lit, "dac"))).otherwise(F.array(F.lit("a")))
    issues = quality.tool_issues(name, F.array(F.lit("a"), F.lit("b")), required)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(issues, ";").alias("issues"))
