"""Secret scans, quality rules and chat formatting against plain Python."""

import hashlib
import math
import re

from codelattice.llm import chat, quality, secrets

A = "AKIA" + "ABCD1234" * 2
H = "0123456789abcdef" * 3
TEXTS = [
    None,
    "",
    "token: short api_key='abcd1234efgh' 𝔘 Password=é secret == 'x' token:api_key:abcdefgh12",
    f"{A} x {H} TOKEN=tokentoken\nuser_name=alice {'Ab3/' * 10} https://db.example.org",
    f"user_name=alice {'z ' * 300} {'Ab3/' * 10}",
    "a b c d e f g h " * 6 + "\nline one\nline one\n \n#*$ \u00a0 \u2003x",
    "w " * 7,
    " ".join(f"w{i}" for i in range(40)) + "\n" + " ".join(f"w{i}" for i in range(3, 12)),
]
RULES = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def docs(spark):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string, score int, source string")


def test_base_spans(spark):
    for row in secrets.scan(docs(spark)).collect():
        text = TEXTS[row.doc_id % len(TEXTS)] or ""
        want = sorted((m.start(), k, name, m.end()) for k, (name, rule, ok) in enumerate(RULES) for m in rule.finditer(text) if ok(m))
        assert row.base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in want).encode()).hexdigest(), row
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w[1] == k for w in want) for k in range(3)]


def test_weak_parts_need_each_other(spark):
    kinds = {r.doc_id: {s.kind for s in r.found} for r in secrets.scan(docs(spark)).collect()}
    assert kinds[3] == {"assign", "access", "hex", "identifier", "opaque", "endpoint"}
    assert kinds[4] == set()


def test_redact(spark):
    out = {r.doc_id: r for r in secrets.redact(docs(spark)).collect()}
    assert out[0].text is None and out[1].text == "" and out[4].text == TEXTS[4]
    assert A not in out[3].text and H not in out[3].text and out[3].text.count("[SECRET]") >= 5
    assert out[2].text.startswith("token: short [SECRET]' 𝔘 Password=é")


def test_quality_measures(spark):
    word = re.compile("[^\x20\x09-\x0d]+")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs(spark), labels).collect()
    assert len(rows) == 2 * len(TEXTS)
    for row in rows:
        text = TEXTS[row.doc_id % len(TEXTS)] or ""
        words = word.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if word.search(x)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and row.kept == (not row.base_failed)


def test_binomial_tail(spark):
    cases = [(0, 100), (3, 100), (4, 100), (9, 100), (700, 20000)]
    rows = spark.createDataFrame(cases, "k int, n int").select("k", "n", quality.binomial_tail(quality.F.col("k"), quality.F.col("n"), 0.05).alias("p")).collect()
    for r in rows:
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.05) + (r.n - i) * math.log(0.95) for i in range(r.k + 1)]
        want = sum(map(math.exp, logs)) if r.k < r.n * 0.05 else 1.0
        assert math.isclose(r.p, want, rel_tol=1e-6)


def test_cutoff_keeps_the_promise(spark):
    rows = [(i, "a", False, 0.4 if i < 10 else 0.01) for i in range(2000)] + [(5000 + i, None, False, 0.01) for i in range(5)]
    measured = spark.createDataFrame(rows, "doc_id long, source string, base_failed boolean, score double")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    found = {r.stratum: r.cutoff for r in quality.cutoffs(measured, labels, stratum="source").collect()}
    assert found == {"a": 0.02}


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "\\h#<\\l:\n### user:\n </turn>\n", "ünï𝔘"]
    rows = [(c, t, role, x) for c in (1, 2, None) for t, (role, x) in enumerate([("user", odd[0]), ("assistant", odd[0]), ("a:\nb", odd[1]), ("assistant", odd[3]), (None, odd[2]), ("assistant", odd[4])])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = chat.read_back(chat.render(chat.fold_events(chat.conversations_as_events(table))))
    out = parsed.collect()
    assert len(out) == 3
    for row in out:
        assert [(t.role, t.text) for t in row.turns] == [(r or "", x or "") for c, _, r, x in rows if c == row.conv_id]
        assert row.loss_text == [odd[0], odd[3], odd[4]]
    assert chat.digest(parsed).count() == 3


def test_events_fold(spark):
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", None, "llo"), (1, 4, 1, "edit", None, "hey"), (1, 5, 2, "regenerate", None, "yo"), (1, 6, 2, "delta", None, "!")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = [(r.role, r.text) for r in chat.fold_events(events).orderBy("seq").collect()]
    assert got == [("user", "hey"), ("assistant", "yo!")]
