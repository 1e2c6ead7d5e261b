"""Queries over whole texts, against brute force, on texts that are longer than the prefixes once read."""

import math
import re
from collections import Counter

from palimpsest import queries, streaming
from palimpsest.functions import rules
from palimpsest.queries import corpus


def documents(spark, folder, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def redacted(text):
    """The text without secrets, and (rule, line, preview)."""
    found = []
    for rule, _, pattern in rules.SECRETS:
        group = rules.SECRET_GROUPS.get(rule, 0)

        def cut(m, rule=rule, group=group, text=text):
            v = m.group(group)
            found.append((rule, text.count("\n", 0, m.start()) + 1, "*" * len(v) if len(v) <= 8 else v[:3] + "*" * min(12, len(v) - 6) + v[-3:]))
            return f'{m.group(1)}="[REDACTED:{rule}]"' if rule == "generic_assignment" else f"[REDACTED:{rule}]"

        text = re.sub(pattern, cut, text, flags=re.ASCII)
    return text, found


def planted(i, text):
    return text + "\n" + corpus._PLANT[i % len(corpus._PLANT)].replace("{n}", str(1000 + i % 9000))


def test_secrets_of_whole_texts(spark, sf_dir, tmp_path):
    own = ["AKIA" + "Q" * 16, "ghp_" + "x" * 36, 'DB_TOKEN = "abcdefabcdefabc"', "redis://u:p4ss@h/1", "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "g" * 12 + "." + "h" * 12 + "." + "i" * 12, 'token = "lower-case-value"']
    rows = [(i, ("word " * 30 + "\n") * (2 + i) + f"a {own[i % 7]} b\n{own[(i + 2) % 7]} c {own[(i + 3) % 7]}\n" + "tail\n" * i) for i in range(14)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    d = documents(spark, tmp_path / "d", rows)
    want = {i: redacted(planted(i, t)) for i, t in rows}
    got = {r.doc_id: r.text for r in queries.QUERIES["redact_secrets"](spark, d).collect()}
    assert got == {i: t for i, (t, _) in want.items()}
    found = sorted((r.doc_id, r.rule, r.line, r.preview) for r in queries.QUERIES["redaction_findings"](spark, d).collect())
    assert found == sorted((i, *f) for i, (_, fs) in want.items() for f in fs)
    assert sum(line > 3 for _, _, line, _ in found) > 28


def embedded(text):
    """Dimension and value, rounded, of a text's hashed words and pairs."""
    words, at = re.findall(corpus.TOKENS, text.lower(), flags=re.ASCII), Counter()
    for f, v in [(w, 1.0) for w in words] + [(f"{a}~{b}", 0.6) for a, b in zip(words, words[1:])]:
        h = 2166136261
        for c in f:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        at[h % 1536] += -v if h >> 16 & 1 else v
    x = {k: math.copysign(math.log1p(abs(v)), v) for k, v in at.items() if abs(v) > 1e-9}
    n = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / n for k, v in x.items()}


def test_embedding_of_whole_texts(spark, sf_dir, tmp_path):
    rows = [(i, f"Same start {'x ' * 300}" + f"last_word{i} ends{i} here") for i in range(3)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 400").limit(12).collect()]
    d = documents(spark, tmp_path / "d", rows)
    got: dict = {i: {} for i, _ in rows}
    for r in queries.QUERIES["hash_embed"](spark, d).collect():
        got[r.doc_id][r.dim] = r.x
    assert got[0] != got[1]
    for i, t in rows:
        want = embedded(t)
        assert set(got[i]) == set(want) and all(abs(got[i][k] - v) < 2e-6 for k, v in want.items()), i


def test_functions_of_whole_texts(spark, tmp_path):
    text = "a <b> & c\n" * 40 + "the end. "
    d = documents(spark, tmp_path / "d", [(1, text, "s", len(text))], "doc_id long, text string, source string, n_chars long")
    lines = queries.QUERIES["line_numbers"](spark, d).first().numbered.split("\n")
    assert len(lines) == 41 and lines[40] == "   41 | the end. "
    r = queries.QUERIES["text_functions"](spark, d).first()
    assert r.escaped == text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") and r.slug == re.sub("[^A-Za-z0-9_.-]+", "-", text).lower()
    assert r.bullets == "\n".join(f"- {x}" for x in text.split(" ")) and r.wrapped == f"<a_b>\n{text}\n</a_b>"


def test_replay_has_every_later_event(spark, sf_dir):
    events = [(r.event_id, r.user_id, r.event_type, r.ts) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    low, high = min(e[0] for e in events), max(e[0] for e in events)
    cut = low + (high - low) // 2
    state: dict = {}
    for e in sorted((e for e in events if e[0] <= cut), key=lambda e: (e[3], e[0])):
        state[e[1]] = (e[1], e[2], max(e[0], state.get(e[1], (0, 0, 0))[2]))
    want = Counter(state.values()) + Counter((e[1], e[2], e[0]) for e in events if e[0] > cut)
    got = Counter((r.user_id, r.event_type, r.event_id) for r in queries.QUERIES["stream_replay"](spark, sf_dir).collect())
    assert got == want and sum(want.values()) > len(events) // 2


def test_drained_rows_stay_out_of_the_driver(spark, sf_dir):
    """A drained stream is files in the shared folder, not a table in the driver's memory; batches are kept once."""
    e = streaming.events_stream(spark, sf_dir).select("event_id")
    out = streaming.drain(e, "append")
    assert out.inputFiles() and all("drained-" in f for f in out.inputFiles())
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
