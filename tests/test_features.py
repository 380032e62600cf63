"""Step features and rules on small hand-made traces: the quirks that the encoded tables don't show."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stepwell.functions import steps as sf
from stepwell.functions import text as tx
from stepwell.operators import corpus, graph, quality, sequence, signals

CALLS = "array<struct<function_name:string,arguments:map<string,string>>>"


def one(spark, value, kind: str, *columns):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return tuple(row) if len(columns) > 1 else row[0]


@pytest.mark.parametrize(
    "command, verb, kind",
    [
        ("cat f 2>/dev/null", "cat", "write"),
        ("cd x && git commit -m y", "git", "explore"),
        ("git cherry-pick a", "git", "explore"),
        ("git add a", "git", "write"),
        ("sed -i s/a/b/ f", "sed", "write"),
        ("sed s/a/b/ f", "sed", "read"),
        ("FOO=1 sudo /usr/bin/GREP x f", "grep", "read"),
        ("ls a0 | wc -l1", "ls", "read"),
        ("", "", "explore"),
        ("cd only", "", "explore"),
        ("env", "", "explore"),
    ],
)
def test_commands(spark, command, verb, kind):
    assert one(spark, command, "string", sf.bash_verb(F.col("x")), sf.op_type(F.col("x"))) == (verb, kind)


def test_segments_keep_their_digits(spark):
    got = one(spark, "cat a0 && ls b1;wc c2", "string", sf.command_segments(F.col("x")), sf.files_touched(F.lit("cat d/0 && ls d/1 | wc d/2")))
    assert got == (["cat a0", "ls b1", "wc c2"], ["d/0", "d/1", "d/2"])


@pytest.mark.parametrize("content, code", [('{"returncode": true}', 1), ('{"returncode": 0.0}', None), ('{"returncode": "1"}', None), ("[1]", None), ("{", None), ('{"returncode": -9}', -9)])
def test_returncodes(spark, content, code):
    assert one(spark, [content], "array<string>", sf.returncode(F.col("x"))) == code


@pytest.mark.parametrize(
    "content, excused",
    [
        ({"returncode": 1, "output": ""}, True), ({"returncode": 1.5, "output": " \n"}, True), ({"returncode": True}, True), ({"returncode": False}, False),
        ({"returncode": "1", "output": ""}, False), ({"returncode": 0}, False), ({"returncode": 2, "stdout": "x"}, False), ({"returncode": 2, "output_head": "x"}, False), ({}, False),
    ],
)
def test_failed_probes(spark, content, excused):
    assert one(spark, json.dumps(content), "string", quality.empty_failure(F.col("x"))) is excused


def test_families_name_every_call(spark):
    bash = lambda c: ("bash", {"command": c})
    for calls, family in (([bash("ls"), bash("grep x")], "bash:grep+bash:ls"), ([(None, {})], "unknown"), ([bash("")], "bash:shell"), ([("bash", None)], "bash:shell"), ([], "action"), (None, "action")):
        assert one(spark, calls, CALLS, sf.operator_family(F.col("x"))) == family


def test_known_fields_win(spark):
    calls = [("bash", {"command": "cat z.py", "cwd": "/w"}), ("edit", {"FilePath": "a.py", "text": "no"})]
    known = F.struct(F.lit("verify").alias("op_type"), F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("string").alias("op_state"), F.lit(None).cast("array<string>").alias("files_touched"))
    meta = one(spark, calls, CALLS, sf.step_meta(F.col("x"), F.array(F.lit('{"returncode": 3}')), known))
    assert (meta.op_type, meta.success, meta.op_state, meta.idempotent, meta.files_touched) == ("verify", False, "fail", True, ["/w", "a.py", "z.py"])


@pytest.mark.parametrize(
    "reply, most, deps",
    [("[2, 2, 1]", 4, [2, 1, 0]), ("see [9] then [3, '1', 2.7]", 4, [3, 1, 2, 0]), ("[1, x]", 4, None), ("none", 4, None), ("[]", 4, [0]), ("[5, 1]", 4, [1, 0]), ("[0]", 4, [0]), ("[1,]", 2, [1, 0]), ("[]", -1, [])],
)
def test_dependency_lists(spark, reply, most, deps):
    assert one(spark, reply, "string", sf.dependency_list(F.col("x"), most)) == deps


def test_annotations(spark):
    for reply, deps, kind in (
        ('so {"dependencies": [1, 7], "op_type": "READ "}', [1, 0], "read"), ('{"deps": [2]}', [2, 0], None), ('{"op_type": "other"}', [0], None), ("[1]", [1, 0], None), ("nothing", None, None),
    ):
        got = one(spark, reply, "string", *sf.annotation(F.col("x"), 3))
        assert got == (deps, kind), reply


def test_texts_of_observations(spark):
    contents = ['{"returncode": 1, "output": "' + "x" * 50 + '", "exception_info": ""}', "plain"]
    whole, shared = one(spark, contents, "array<string>", sf.clipped_observation(F.col("x"), 30), sf.shared_observation(F.col("x"), 200))
    assert whole == "returncode: 1\noutput: xxxxxxxx...<truncated>"
    assert shared == "returncode: 1\noutput: " + "x" * 50 + "\nplain"
    assert one(spark, ['{"output": null}', "ab", "[1]"], "array<string>", sf.observation_chars(F.col("x"))) == 4 + 2 + 3


def test_text_states(spark):
    for text, state in (("returncode: 0 returncode: -1", "fail"), ("returncode: 0, Traceback (most recent call last)", "success"), ("Permission DENIED", "fail"), ("", "success")):
        assert one(spark, text, "string", sf.text_op_state(F.col("x"))) == state


def trial(rows):
    """(i, op_type, op_state, deps, chars) -> steps of one trial"""
    return [(1, i, t, s, "f", c, d) for i, t, s, d, c in rows]


SCHEMA = "trial_id long, i int, op_type string, op_state string, family string, obs_chars long, deps array<int>"


def test_eight_steps_give_three_signals(spark):
    kinds = ["read", "read", "explore", "explore", "explore", "explore", "explore", "read"]
    states = ["success", "success", "fail", "fail", "success", "success", "success", "success"]
    deps = [[0]] * 7 + [[0, 1, 2, 5]]
    steps = spark.createDataFrame(trial([(i + 1, kinds[i], states[i], deps[i], 10) for i in range(8)]), SCHEMA)
    found = {r.type: (r.first_step, r.last_step, r.score) for r in signals.select_top(signals.candidates(steps)).collect()}
    assert found == {"mergeable": (1, 2, 175), "failure_pivot": (3, 4, 180), "skippable": (3, 4, 144)}


def test_a_chain_gives_only_phases(spark):
    rows = [(i, "read" if i <= 13 else "verify", "success", [0, i - 1] if i > 1 else [0], 10) for i in range(1, 26)]
    steps = spark.createDataFrame([(t, i, k, s, f"f{i}", c, d) for t, i, k, s, _, c, d in trial(rows)], SCHEMA)
    found = signals.select_top(signals.candidates(steps)).collect()
    assert 1 <= len(found) <= 3 and {r.type for r in found} == {"phase_fallback"} and max(r.last_step - r.first_step + 1 for r in found) <= 12


def test_candidates_read_the_steps_once(spark):
    steps = spark.range(100).selectExpr("id % 7 AS trial_id", "CAST(id AS INT) AS i", "'read' AS op_type", "'fail' AS op_state", "'f' AS family", "id AS obs_chars", "array(0) AS deps")
    plan = signals.candidates(steps)._jdf.queryExecution().executedPlan().toString()
    text = plan.split("== Initial Plan ==")[0]
    assert text.count("Range (") <= 6 and "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_merged_steps_and_slices(spark):
    bash = lambda c: [("bash", {"command": c})]
    rows = [(1, 2, bash("b"), ["r2"], " two ", [0, 1]), (1, 1, bash("a"), None, None, [0]), (1, 3, bash("c"), ["r3"], "three", [0])]
    steps = spark.createDataFrame(rows, f"trial_id long, i int, calls {CALLS}, contents array<string>, message string, deps array<int>")
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 9)], "trial_id long, i int")
    part = signals.trajectory_slice(steps, chosen)
    assert sorted(r.display_index for r in part.collect()) == [1, 2]
    got = signals.merge_steps(part, ["trial_id"]).first()
    assert ([c.arguments["command"] for c in got.calls], got.contents, got.message, got.merged_from, got.shared_deps) == (["a", "b"], ["r2"], "two", [1, 2], [0])


def test_consumers_of_sets(spark):
    steps = spark.createDataFrame([(1, i, d) for i, d in ((1, [0]), (2, [0, 1]), (3, [0, 1]), (4, [0, 2]), (5, [0, 4]))], "trial_id long, i int, deps array<int>")
    chosen = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 4)], "trial_id long, set_id long, i int")
    assert {r.set_id: r.consumer for r in graph.set_consumer(steps, chosen).collect()} == {7: 3, 8: 5}
    kept = spark.createDataFrame([(1, 4)], "trial_id long, i int")
    assert {r.set_id: r.consumer for r in graph.set_consumer(steps, chosen, kept).collect()} == {7: 4}
    assert one(spark, [3, 1, 1, -1, 9, None], "array<int>", graph.normal_deps(F.col("x"), F.lit(4))) == [3, 1, 0]


def test_rollouts(spark):
    def report(rows, expected=None):
        trials = spark.createDataFrame(rows, "case_id string, exception string, tools int")
        trials = trials.select("case_id", quality.trial_errors(F.col("exception"), F.lit(True), F.lit(True), F.col("tools")).alias("errors"))
        wanted = spark.createDataFrame([(e,) for e in expected], "case_id string") if expected else None
        return trials, quality.rollout_report(trials, wanted).first()

    _, got = report([("case-a", None, 1)])
    assert got.valid and got.valid_trial_count == 1
    trials, got = report([("case-a", "AgentError", 0)], ["case-a", "case-b"])
    assert trials.first().errors == ["trial_exception:AgentError", "no_agent_tool_action"]
    assert (got.valid, got.missing, got.invalid) == (False, 1, 1)
    assert not report([("case-a", None, 1), ("case-a", None, 2)])[1].valid
    assert not report([], ["case-a"])[1].valid


def test_batches_close_at_the_budget(spark):
    rows = spark.createDataFrame([("g", i, 6) for i in range(3)] + [("h", 0, 1)], "g string, i int, n int")
    got = {(r.g, r.i): r.batch for r in sequence.pack_batches(rows, "g", "i", "n", 10, 8).collect()}
    assert got == {("g", 0): 0, ("g", 1): 1, ("g", 2): 2, ("h", 0): 0}
    with pytest.raises(Exception, match="over the budget"):
        sequence.pack_batches(rows, "g", "i", "n", 5, 8).collect()


def test_requests_of_entries(spark):
    shape = "struct<lines:string,head:int,tail:int,start:int,end:int,number:boolean>"
    for entry, shared, want in (
        ((None, 3, None, None, None, None), ("1-2", None, None, 4, None, True), (None, 3, None, None, None, True)),
        ((None, None, None, None, 9, False), (None, None, 2, 4, 5, True), (None, None, None, 4, 9, False)),
        ((None, None, None, None, None, None), ("1-2", None, None, None, None, None), ("1-2", None, None, None, None, False)),
    ):
        got = spark.createDataFrame([(entry, shared)], f"a {shape}, b {shape}").select(corpus.resolved_request(F.col("a"), F.col("b")).alias("r")).first().r
        assert tuple(got) == want
    none = F.lit(None).cast("int")
    for lines, head, tail, want in (("0-3", None, None, (0, 3)), (None, 2, 5, (1, 2)), (None, None, 3, (8, 10)), (None, None, None, (1, 10))):
        a, b = sf.read_request(F.lit(lines).cast("string"), F.lit(head).cast("int"), F.lit(tail).cast("int"), none, none, F.lit(10))
        assert tuple(spark.range(1).select(a, b).first()) == want


def test_text_helpers(spark):
    assert one(spark, "Café Ünïted", "string", tx.ascii_fold(F.col("x")), tx.title_key(F.lit("a-b:  c")), tx.html_unescape(F.lit("a &amp; b &#39;"))) == ("cafe united", "a b c", "a & b '")
    for text, want in (('x {"a": 1} y {"b": {"c": 2}} z', {"c": 2}), ('{"a": [1, 2', None), ("", None), ("{} {bad", {}), (None, None)):
        got = one(spark, text, "string", tx.last_json_object(F.col("x")))
        assert (got and json.loads(got)) == want or (got == "{}" and want == {})
    diff = one(spark, "a\nb\n", "string", tx.unified_diff(F.col("x"), F.lit("a\nc\n"), F.lit("t")), tx.unified_diff(F.col("x"), F.col("x"), F.lit("t")))
    assert diff == ("--- a/t\n+++ b/t\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n", "")
    assert one(spark, "aXbX", "string", tx.replace_first(F.col("x"), F.lit("X"), F.lit("$1")), tx.replace_first(F.col("x"), F.lit(""), F.lit("y"))) == ("a$1bX", "aXbX")
    assert one(spark, "https://arxiv.org/abs/2101.00001v3?x", "string", tx.pdf_url(F.col("x")), tx.pdf_url(F.lit("https://x.org/a")), tx.on_host(F.col("x"), tx.PAPER_HOSTS)) == ("https://arxiv.org/pdf/2101.00001.pdf", None, True)
    assert one(spark, None, "string", tx.slug(F.col("x"), F.lit(" A: b\tC ")), tx.slug(F.col("x"), F.lit("?!")), tx.slug(F.lit("2101.1"), F.col("x"))) == ("a_b_c", "untitled", "2101_1")


def test_flags_of_steps(spark):
    rows = [(1, 1, "read", "cat", 0, "", ["a"]), (1, 2, "write", "rm", 124, "Timed out", []), (1, 3, "read", "cat", 0, "", ["a"]), (1, 4, "read", "grep", 1, "", ["b"]), (1, 5, "explore", "x", None, "", [])]
    got = corpus.step_flags(spark.createDataFrame(rows, "trial_id long, i int, op_type string, verb string, rc int, output string, files array<string>")).orderBy("i").collect()
    assert [(r.is_wasted, r.is_timeout, r.is_redundant_read) for r in got] == [(False, False, False), (True, True, False), (False, False, True), (False, False, False), (False, False, False)]


def test_html_fields_in_any_attribute_order(spark):
    html = """<head><title lang="en">Plain &amp;
 <i>simple</i></title><META content='Tom &amp; "Ann" > all' data-name="x" name='citation_title'><meta name="description" content="">
<meta name=citation_date content=2021/05><blockquote class="x">no</blockquote><BLOCKQUOTE id="q" class='big abstract'>\n<b>Abstract:</b> a &lt; b</BLOCKQUOTE>"""
    x = F.col("x")
    assert one(spark, html, "string", tx.readable(tx.html_title(x)), tx.readable(tx.html_abstract(x)), tx.html_year(x), tx.readable(tx.html_meta(x, "citation_title"))) == ('Tom & "Ann" > all', "a < b", "2021", 'Tom & "Ann" > all')
    assert one(spark, "<title>Plain &amp;\n <i>simple</i></title>", "string", tx.readable(tx.html_title(x)), tx.html_abstract(x), tx.html_year(x)) == ("Plain & simple", "", "")
    assert one(spark, "", "string", tx.html_title(x), tx.html_abstract(x), tx.html_year(x), tx.html_meta(x, "a")) == ("", "", "", "")
    assert one(spark, None, "string", tx.html_title(x), tx.html_abstract(x), tx.html_year(x), tx.html_meta(x, "a")) == (None, None, None, None)


def test_pdf_rules(spark):
    known = {
        "http://export.arxiv.org/pdf/2101.00001v2": "https://arxiv.org/pdf/2101.00001.pdf",
        "https://openreview.net/forum?id=a1": "https://openreview.net/pdf?id=a1",
        "https://openreview.net/pdf?id=a1": "https://openreview.net/pdf?id=a1",
        "https://proceedings.neurips.cc/paper_files/paper/2023/hash/ab12-Abstract.html": "https://proceedings.neurips.cc/paper_files/paper/2023/file/ab12-Paper.pdf",
        "https://proceedings.mlr.press/v1/x.html": "https://proceedings.mlr.press/v1/x.pdf",
        "https://aclanthology.org/2020.x//": "https://aclanthology.org/2020.x.pdf",
        "https://aclanthology.org/2020.y": "https://aclanthology.org/2020.y.pdf",
        "https://x.org/a.PDF": "https://x.org/a.PDF",
        "https://notarxiv.org/abs/2101.00001": None,
        "": None,
        None: None,
    }
    for url, pdf in known.items():
        assert one(spark, url, "string", tx.pdf_url(F.col("x"))) == pdf, url


def test_canonical_json(spark):
    text = '{"b": [1, 2.50, {"y": null, "x": "\\u00e9\\n"}], "a": true, "a": false}'
    x = F.col("x")
    spaced, tight, kept = tx.canonical_json(), tx.canonical_json(spaced=False), tx.canonical_json(ordered=False)
    assert one(spark, text, "string", spaced(x), tight(x), kept(x)) == (
        '{"a": false, "b": [1, 2.5, {"x": "é\\n", "y": null}]}',
        '{"a":false,"b":[1,2.5,{"x":"é\\n","y":null}]}',
        '{"b": [1, 2.5, {"y": null, "x": "é\\n"}], "a": false}',
    )
    for broken in ("", "{", None, "[" * 100_000):
        assert one(spark, broken, "string", spaced(x)) is None
    assert one(spark, ' "a" ', "string", tx.identity(x)) == one(spark, '"\\u0061"', "string", tx.identity(x))


def test_markdown_says_what_it_leaves_out(spark):
    from stepwell.sources.sinks import markdown_table

    rows = spark.range(3)
    assert markdown_table(rows, 3).endswith("| 2 |") and "Only the first 2 rows" in markdown_table(rows, 2)


def test_entities_cut_short_stay(spark):
    rows = spark.createDataFrame([("a &amp; &lt;b&gt; &quot;c&#39; &amp;lt; d &amp",), ("&#3",), ("&nbsp;&amp;amp;",), (None,)], "x string")
    assert [r[0] for r in rows.select(tx.unescaped(F.col("x"))).collect()] == ["a & <b> \"c' &lt; d &amp", "&#3", "&nbsp;&amp;", None]


def test_readable_titles_of_cut_pages(spark, tmp_path, same_as_sql):
    from stepwell.plans import relational_queries

    pages = [(1, "<title>A &amp; B</title>"), (2, "<title>A &amp</title>"), (3, "<title>&quot</title>"), (4, "no title"), (5, "<title>&#39;x &nbsp;</title>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert same_as_sql(relational_queries.readable_titles, relational_queries.ORACLES["readable_titles"], str(tmp_path)) == 5


def test_paper_numbers_are_not_cut(spark, tmp_path, same_as_sql):
    from stepwell.plans import corpus_queries

    url = "https://arxiv.org/abs/2101.110000v2"
    assert one(spark, url, "string", tx.arxiv_id(F.col("x")), tx.pdf_url(F.col("x"))) == ("2101.110000", "https://arxiv.org/pdf/2101.110000.pdf")
    spark.range(89_990, 90_010).selectExpr("id AS page_id").write.parquet(f"{tmp_path}/pages.parquet")
    assert same_as_sql(corpus_queries.pdf_addresses, corpus_queries.ORACLES["pdf_addresses"], str(tmp_path)) == 20


def test_a_row_over_the_budget_is_a_batch_of_its_own(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([11, 0, 4, 12, 6, 5, 99])] + [("h", 0, 11)], "g string, i int, n int")
    got = {(r.g, r.i): r.batch for r in sequence.pack_batches(rows, "g", "i", "n", 10, 8, alone=True).collect()}
    assert got == {("g", 0): 0, ("g", 1): 1, ("g", 2): 1, ("g", 3): 2, ("g", 4): 3, ("g", 5): 4, ("g", 6): 5, ("h", 0): 0}


def test_packing_of_steps_over_the_budget(spark, tmp_path, same_as_sql):
    from stepwell.plans import trace_queries

    values = [700.0, 1.0, 599.0, 0.0, 600.01, 600.0] + [0.5] * 20 + [900.0, 900.0]
    rows = [(i, i, 1 + i // 14, "view", v, '{"k": 1}') for i, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    assert same_as_sql(trace_queries.pack_batches, trace_queries.ORACLES["pack_batches"], str(tmp_path)) == len(values)
