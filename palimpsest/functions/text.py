"""Column functions over text: redaction, masks, paths, escapes, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def mask(value: Column) -> Column:
    """Up to 8 characters: stars; more: the first and last 3 around at most 12 stars."""
    n = F.length(value)
    middle = F.repeat(F.lit("*"), F.least(F.lit(12), n - 6))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(3)), middle, F.right(value, F.lit(3))))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _with(value: Column, body) -> Column:
    """body(value), with the value made once for all its uses: an expression used by name is copied into each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


_FINDINGS = "array<struct<rule: string, label: string, line: int, preview: string>>"


def redacted(text: Column, secrets=rules.SECRETS) -> Column:
    """(text, findings): secrets replaced by markers, rule after rule on the text as rewritten so far, and what was found.

    findings: array of (rule, label, line in the text that the rule saw, preview), in order of rules and places. Each
    rule is one step over the state of those before, so the expression grows with the number of rules and no faster.
    """

    def step(rule: str, name: str, pattern: str):
        p, group = F.lit(pattern), F.lit(rules.SECRET_GROUPS.get(rule, 0))
        marker = F.lit(f'$1="[REDACTED:{rule}]"' if rule == "generic_assignment" else f"[REDACTED:{rule}]")

        def found(state: Column) -> Column:
            values = F.regexp_extract_all(state["text"], p, group)
            inside = F.transform(F.regexp_extract_all(state["text"], p, F.lit(0)), newlines)
            between = F.transform(F.split(state["text"], pattern), newlines)
            # A match stands on line 1 + newlines in the pieces up to it and in the matches before it.
            total = lambda counts: F.aggregate(counts, F.lit(0), lambda n, x: n + x)
            line = lambda n, b, i: (1 + total(F.slice(b, F.lit(1), i + 1)) + total(F.slice(n, F.lit(1), i))).cast("int")
            return _with(
                F.struct(inside.alias("n"), between.alias("b")),
                lambda c: F.transform(values, lambda v, i: F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("label"), line(c["n"], c["b"], i).alias("line"), mask(v).alias("preview"))),
            )

        def after(state: Column) -> Column:
            changed = F.struct(F.regexp_replace(state["text"], p, marker).alias("text"), state["low"].alias("low"), F.concat(state["findings"], found(state)).alias("findings"))
            marks = [F.contains(state["low"], F.lit(m)) for m in rules.SECRET_MARKS.get(rule, ())]
            marked = reduce(lambda a, b: a | b, marks) if marks else F.lit(True)
            return F.when(marked & state["text"].rlike(pattern), changed).otherwise(state)

        return after

    # Markers hold no upper-case name and none of the other marks, so the first text shows all marks that later ones can have.
    state = F.struct(text.alias("text"), F.lower(text).alias("low"), F.array().cast(_FINDINGS).alias("findings"))
    for secret in secrets:
        state = _with(state, step(*secret))
    return F.when(text.isNotNull(), state)


def redact(df: DataFrame, text: str = "text", findings: str = "findings", secrets=rules.SECRETS) -> DataFrame:
    """The column `text` without secrets, and a column of what was found (see `redacted`)."""
    held = next(n for n in (f"__redacted{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)
    made = df.withColumn(held, redacted(F.col(text), secrets))
    return made.withColumns({text: F.col(held)["text"], findings: F.coalesce(F.col(held)["findings"], F.array().cast(_FINDINGS))}).drop(held)


def scrub_map(values: Column) -> Column:
    """Values of a map<string,string> whose key names a secret become [redacted]."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(rules.LOG_KEYS), F.lit("[redacted]")).otherwise(v))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By file name, dockerfile*, then last extension; else Other."""
    base = F.lower(file_name(path))
    ending = F.when(base.contains("."), F.element_at(F.split(base, r"\."), -1)).otherwise(F.lit(""))
    return F.coalesce(lookup(rules.LANGUAGE_OF_FILE, base), F.when(base.startswith("dockerfile"), F.lit("Dockerfile")), lookup(rules.LANGUAGE_OF_EXTENSION, ending), F.lit("Other"))


def is_code(lang: Column) -> Column:
    return ~lang.isin(*rules.NOT_CODE)


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for pattern in rules.TEST_PATHS:
        out = out | path.rlike(pattern)
    return out


def line_count(text: Column) -> Column:
    """Parts between newlines: one more than there are."""
    return newlines(text) + 1


def directory(path: Column, depth: int = 2) -> Column:
    """The first directories of a path, or (root)."""
    parts = F.split(path, "/")
    found = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")
    return F.when(F.size(parts) > 1, found).otherwise(F.lit("(root)"))


def repository_name(url: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", ""), "/"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.regexp_replace(F.array_join(last, "/"), r"\.git$", "")


def query_terms(text: Column, most: int = 12) -> Column:
    """Identifiers of three characters or more, lower-cased, with repeats, the first `most`."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)), 1, most), F.lower)


def claim_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9+#.]{2,})"), F.lit(1))


def truncate(text: Column, most: int) -> Column:
    cut = F.concat(F.left(text, F.lit(most)), F.lit("\n… ["), (F.length(text) - most).cast("string"), F.lit(" characters truncated]"))
    return F.when(F.length(text) > most, cut).otherwise(text)


def numbered(text: Column, first: Column) -> Column:
    """Lines with their number, 5 wide, and a bar."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line, i: F.concat(F.lpad((i + first).cast("string"), 5, " "), F.lit(" | "), line)), "\n")


def delimited(label: Column, text: Column) -> Column:
    tag = F.regexp_replace(label, "[^a-zA-Z0-9_-]", "_")
    return F.concat(F.lit("<"), tag, F.lit(">\n"), text, F.lit("\n</"), tag, F.lit(">"))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def citation(path: Column, first: Column, last: Column) -> Column:
    return F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))


def label(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(lookup(values, key), key)


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-"))


def interval_text(days: Column) -> Column:
    """Minutes, hours, days, months, years."""
    said = lambda n, unit: F.concat(F.round(n).cast("long").cast("string"), F.lit(unit))
    return F.when(days < 1 / 24, said(days * 24 * 60, "m")).when(days < 1, said(days * 24, "h")).when(days < 30, said(days, "d")).when(days < 365, said(days / 30, "mo")).otherwise(F.concat(F.format_number(days / 365, 1), F.lit("y")))


def _two_decimals(x: Column) -> Column:
    """Rounded by the number's exact value; exact ties, which are odd eighths, go up."""
    up = F.when(F.pmod(x * 8, F.lit(2.0)) == 1, F.lit(0.001)).otherwise(F.lit(0.0))
    return F.call_function("format_number", (x + up).cast("double"), F.lit("0.00"))


def cents_text(cents: Column) -> Column:
    return F.when(cents < 1, F.concat(_two_decimals(cents), F.lit("¢"))).otherwise(F.concat(F.lit("$"), _two_decimals(cents / 100)))


def email_allowed(email: Column, domains: list[str]) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2))).isin(*[d.lower() for d in domains]) if domains else F.lit(True)


def term_weight(text: Column, term: Column) -> Column:
    """min(1, 0.3 + 0.2 n) for a term of 3 characters or more that occurs n > 0 times; else null."""
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.when((F.length(term) >= 3) & (n > 0), F.least(F.lit(1.0), 0.3 + 0.2 * n))


def fingerprint(versions: Column) -> Column:
    """name@version, by comma, of a map."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(versions)), lambda e: F.concat(e["key"], F.lit("@"), e["value"].cast("string"))), ",")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lenient_json(text: Column) -> Column:
    """A fenced block, else the widest {...} or [...] of a model's answer."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    wide = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(fenced != "", F.regexp_replace(fenced, r"^\s+|\s+$", "")).when(wide != "", wide)


def iso_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")
