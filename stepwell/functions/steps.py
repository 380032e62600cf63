"""Column builders for agent steps: commands, return codes, files, families.

A tool call is struct<function_name, arguments: map<string,string>>; an observation is
an array of result contents, each JSON text ``{returncode, output, exception_info}`` or
plain text.  All builders stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which kind of step a command's verb makes.
READ_VERBS = ["cat", "head", "tail", "sed", "grep", "rg", "find", "ls", "nl", "wc", "file", "stat", "awk", "less", "more", "od"]
WRITE_VERBS = ["rm", "mv", "cp", "mkdir", "touch", "chmod", "chown", "tee", "ln", "truncate", "install"]
VERIFY_VERBS = ["go", "cargo", "npm", "npx", "pytest", "make", "mvn", "gradle", "python", "python3", "ruby", "node"]
GIT_WRITES = ["checkout", "reset", "apply", "add", "commit", "stash", "rm", "mv", "init", "rebase", "merge"]
PREFIX_WORDS = ["sudo", "env", "time", "nohup", "exec"]
ERROR_MARKS = [
    "no such file or directory",
    "file not found",
    "command not found",
    "permission denied",
    "traceback (most recent call last)",
    "exception_info:",
]


def bash_command(calls: Column) -> Column:
    """Command of the first bash call that has arguments; else the empty text."""
    bash = F.filter(calls, lambda c: (c["function_name"] == "bash") & c["arguments"].isNotNull())
    return F.coalesce(F.try_element_at(F.get(bash, F.lit(0))["arguments"], F.lit("command")), F.lit(""))


def command_segments(command: Column) -> Column:
    """Parts between && || | ; (quotes are not looked at), trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(command, r"&&|\|\||[|;]"), lambda s: F.trim(s)), lambda s: s != "")


def _segment_verb(segment: Column) -> Column:
    """Base name of the first word that is no assignment or wrapper; empty for cd."""
    words = F.filter(F.split(segment, r"\s+"), lambda t: t != "")
    skip = lambda t: (t.contains("=") & ~t.startswith("-")) | t.isin(PREFIX_WORDS)
    head = F.aggregate(words, F.lit("").cast("string"), lambda acc, t: F.when(acc != "", acc).when(skip(t), "").otherwise(t))
    return F.when(head == "cd", "").otherwise(F.lower(F.regexp_extract(head, r"([^/]*)$", 1)))


def bash_verbs(command: Column) -> Column:
    """Verbs of all segments, segments without one and changes of directory left out."""
    return F.filter(F.transform(command_segments(command), _segment_verb), lambda v: v != "")


def bash_verb(command: Column) -> Column:
    return F.coalesce(F.get(bash_verbs(command), F.lit(0)), F.lit(""))


def op_type(command: Column) -> Column:
    """read, write, verify or explore, from the command alone.

    A redirection makes cat and tee a write, even one of errors only; the git subcommand
    counts only where git is the first word of the command.
    """
    verb = bash_verb(command)
    git = F.regexp_extract(command, r"^\s*git\s+(\w+)", 1)
    return (
        F.when((verb == "sed") & command.rlike(r"\bsed\b[^|]*\s-i\b"), "write")
        .when(verb.isin("cat", "tee") & command.rlike(r">\s*>|>\s*\S"), "write")
        .when(verb == "git", F.when(git.isin(GIT_WRITES), "write").otherwise("explore"))
        .when(verb.isin(WRITE_VERBS), "write")
        .when(verb.isin(VERIFY_VERBS), "verify")
        .when(verb.isin(READ_VERBS), "read")
        .otherwise("explore")
    )


def returncode(contents: Column) -> Column:
    """First integer (or boolean) returncode among JSON contents; floats do not count."""

    def one(text: Column) -> Column:
        value = F.try_variant_get(F.try_parse_json(text), "$.returncode", "string")
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.returncode", "variant"))
        code = F.when(kind == "BIGINT", value.try_cast("bigint"))
        return code.when(kind == "BOOLEAN", F.when(value == "true", 1).otherwise(0))

    return F.get(F.array_compact(F.transform(contents, one)), F.lit(0))


def step_success(contents: Column) -> Column:
    code = returncode(contents)
    return F.when(code.isNotNull(), code == 0).otherwise(F.lit(True))


def files_touched(command: Column) -> Column:
    """Words that look like paths, quotes stripped, repeats kept; options and a=b are none."""
    words = F.flatten(F.transform(command_segments(command), lambda s: F.split(s, r"\s+")))
    path = lambda t: (t.contains("/") | t.rlike(r"\.\w{1,8}$")) & ~t.startswith("-")
    paths = F.filter(words, lambda t: path(t) & (~t.contains("=") | t.startswith("/")) & ~t.isin([*PREFIX_WORDS, "cd"]))
    return F.transform(paths, lambda t: F.regexp_replace(t, "^[\"']+|[\"']+$", ""))


def observation_chars(contents: Column) -> Column:
    """Characters of outputs; of the whole content where it has none."""

    def one(text: Column) -> Column:
        output = F.try_variant_get(F.try_parse_json(text), "$.output", "string")
        held = F.length(F.coalesce(output, F.lit("None")))  # a null output is written as None
        known = F.try_variant_get(F.try_parse_json(text), "$.output", "variant").isNotNull()
        return F.when(known, held).otherwise(F.coalesce(F.length(text), F.lit(0))).cast("bigint")

    return F.coalesce(F.aggregate(F.transform(contents, one), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))


def operator_family(calls: Column) -> Column:
    """Sorted distinct call names joined by +; every bash call names its own verb, a null name is unknown."""

    def name(c: Column) -> Column:
        verb = bash_verb(F.coalesce(F.try_element_at(c["arguments"], F.lit("command")), F.lit("")))
        bash = F.concat(F.lit("bash:"), F.when(verb == "", "shell").otherwise(verb))
        plain = F.coalesce(F.nullif(c["function_name"], F.lit("")), F.lit("unknown"))
        return F.when(plain == "bash", bash).otherwise(plain)

    joined = F.array_join(F.array_sort(F.array_distinct(F.transform(calls, name))), "+")
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, joined).otherwise("action")


def is_idempotent(kind: Column) -> Column:
    """Every step that doesn't write."""
    return kind != "write"


def step_files(calls: Column, known: Column | None = None) -> Column:
    """Sorted files of a step: those of its command, or ``known`` ones instead, and arguments named as a place."""
    place = lambda k, v: F.lower(k).rlike("file|path|cwd|dir") & v.isNotNull()
    extra = F.flatten(F.transform(calls, lambda c: F.coalesce(F.map_values(F.map_filter(c["arguments"], place)), F.array().cast("array<string>"))))
    own = files_touched(bash_command(calls))
    own = own if known is None else F.coalesce(known, own)
    return F.array_sort(F.array_distinct(F.concat(own, F.coalesce(extra, F.array().cast("array<string>")))))


def step_meta(calls: Column, contents: Column, known: Column | None = None) -> Column:
    """Rule fields of a step; fields that ``known`` holds (a struct, nulls are absent) win."""
    command = bash_command(calls)

    def field(name: str, rule: Column) -> Column:
        return rule if known is None else F.coalesce(known[name], rule)

    kind = op_type(command)
    success = field("success", step_success(contents))
    return F.struct(
        field("op_type", kind).alias("op_type"),
        success.alias("success"),
        field("op_state", F.when(success, "success").otherwise("fail")).alias("op_state"),
        is_idempotent(kind).alias("idempotent"),
        bash_verbs(command).alias("bash_verbs"),
        step_files(calls, None if known is None else known["files_touched"]).alias("files_touched"),
    )


def text_op_state(text: Column) -> Column:
    """success if all stated return codes are zero; without any, if no error mark occurs."""
    codes = F.regexp_extract_all(text, F.lit(r"returncode:\s*(-?\d+)"), F.lit(1))
    marked = F.lit(False)
    for mark in ERROR_MARKS:
        marked = marked | F.lower(text).contains(mark)
    zero = F.forall(codes, lambda c: c.try_cast("bigint") == 0)
    return F.when(F.size(codes) > 0, F.when(zero, "success").otherwise("fail")).otherwise(F.when(marked, "fail").otherwise("success"))


def _bounded(numbers: Column, most: Column | int) -> Column:
    """Distinct numbers of 0 .. most, with 0 at the end if it is absent and most allows it."""
    top = F.lit(most) if isinstance(most, int) else most
    fine = F.array_distinct(F.filter(numbers, lambda x: (x >= 0) & (x <= top)))
    return F.when(F.array_contains(fine, 0) | (top < 0), fine).otherwise(F.concat(fine, F.array(F.lit(0))))


def dependency_list(text: Column, most: Column | int) -> Column:
    """The last [...] of a reply as integers of 0 .. most, first occurrences, 0 added.

    Null where there is no list or an entry is no integer: such replies are set aside.
    Quoted integers and floats count, floats cut to integers, as do True and False.
    """
    found = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    parts = F.transform(F.split(F.regexp_replace(F.element_at(found, -1), r",\s*$", ""), ","), lambda x: F.trim(x))
    parts = F.when(F.trim(F.element_at(found, -1)) == "", F.array().cast("array<string>")).otherwise(parts)

    def number(x: Column) -> Column:
        bare = F.regexp_replace(x, r"^(['\"])\s*([+-]?\d+)\s*\1$", "$2")
        truth = F.when(x == "True", 1).when(x == "False", 0)
        whole = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("int"))
        real = F.when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$"), x.try_cast("double").try_cast("int"))
        return F.coalesce(truth, whole, real)

    numbers = F.transform(parts, number)
    good = F.forall(numbers, lambda x: x.isNotNull())
    return F.when((F.size(found) > 0) & good, _bounded(numbers, most))


def annotation(text: Column, most: Column | int) -> tuple[Column, Column]:
    """Dependencies and kind of a reply {dependencies or deps, op_type or operation_type}; a bare list has no kind.

    An object without dependencies depends on the start alone.  Kinds beyond the four are null.
    """
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    whole = F.schema_of_variant(parsed).startswith("OBJECT")
    value = lambda path, kind: F.try_variant_get(parsed, path, kind)
    listed = F.coalesce(value("$.dependencies", "string"), value("$.deps", "string"))
    none = F.array().cast("array<int>")
    deps = F.when(whole, F.when(listed.isNull(), _bounded(none, most)).otherwise(dependency_list(listed, most)))
    kind = F.lower(F.trim(F.coalesce(value("$.op_type", "string"), value("$.operation_type", "string"))))
    fine = F.when(kind.isin("read", "write", "verify", "explore"), kind)
    return F.when(F.coalesce(whole, F.lit(False)), deps).otherwise(dependency_list(text, most)), fine


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...<truncated>"))).otherwise(text)


def rendered_result(content: Column) -> Column:
    """Return code, output and exception of a JSON result, a line each; other contents as they are."""
    parsed = F.try_parse_json(content)
    get = lambda f: F.try_variant_get(parsed, f"$.{f}", "string")
    line = lambda f: F.when(F.coalesce(get(f), F.lit("")) != "", F.concat(F.lit(f"{f}: "), get(f)))
    lines = F.concat_ws("\n", F.when(get("returncode").isNotNull(), F.concat(F.lit("returncode: "), get("returncode"))), line("output"), line("exception_info"))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT") & (lines != ""), lines).otherwise(content)


def clipped_observation(contents: Column, most: int = 800) -> Column:
    return clip(F.array_join(F.transform(contents, rendered_result), "\n"), most)


def shared_observation(contents: Column, budget: int) -> Column:
    """Every result gets an equal share of the budget, 80 characters at least; the whole is clipped again."""
    share = F.greatest(F.lit(80), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.size(contents)))).cast("int")

    def one(text: Column) -> Column:
        whole = rendered_result(text)
        return F.when(F.length(whole) > share, F.concat(F.substring(whole, F.lit(1), share), F.lit("...<truncated>"))).otherwise(whole)

    return clip(F.array_join(F.transform(contents, one), "\n"), budget)


def truncate_output(text: Column, limit: int) -> Column:
    notice = F.concat(F.substring(text, 1, limit), F.lit("\n... ["), (F.length(text) - limit).cast("string"), F.lit(" characters cut]"))
    return F.when(F.length(text) > limit, notice).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("bigint")


def token_cost(n_input: Column, cached: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    return (n_input - cached) * price_in + cached * price_cached + output * price_out


def read_request(lines: Column, head: Column, tail: Column, start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """First and last line (from 1) of a read: range text, head, tail, start/end, else 50 lines."""
    low = F.regexp_extract(lines, r"^(\d+)-(\d+)$", 1).try_cast("bigint")
    high = F.regexp_extract(lines, r"^(\d+)-(\d+)$", 2).try_cast("bigint")
    first = F.when(low.isNotNull(), low).when(head.isNotNull(), 1).when(tail.isNotNull(), F.greatest(F.lit(1), total - tail + 1)).otherwise(F.coalesce(start, F.lit(1)))
    last = F.when(low.isNotNull(), high).when(head.isNotNull(), head).when(tail.isNotNull(), total)
    last = last.when(start.isNotNull() | end.isNotNull(), F.coalesce(end, total)).otherwise(50)
    return first.cast("bigint"), F.least(last, total).cast("bigint")


def transient_error(name: Column, status: Column) -> Column:
    """Errors worth another try."""
    return F.coalesce(status.isin(408, 409, 425, 429) | (status >= 500), F.lit(False)) | F.coalesce(
        F.lower(name).rlike("timeout|connection|ratelimit|temporar|overload"), F.lit(False)
    )


def glob_regex(pattern: str) -> str:
    """A shell glob (* ? [..]) as an anchored regular expression."""
    import fnmatch

    return "^" + fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")
