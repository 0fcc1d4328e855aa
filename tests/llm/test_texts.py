"""Decontamination, license scans, chat formatting and mixing against brute force and round trips."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import chat, decontam, licenses, mixing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(ASCII))


@pytest.fixture(scope="module")
def items(spark, texts):
    long = next(t for i, t in texts if i == 18)
    rows = [(1, long[200:420]), (10, "one TWO"), (2, None), (3, ""), (4, "é"), (None, "w1"), (5, "one two"), (6, "never seen words")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination(odd, texts, items, block):
    wins = defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 9)) if w and r["item_id"] is not None else ():
            wins[tuple(w[k : k + 10])].add(str(r["item_id"]))
    want = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        want.append(((i is None, i or 0), len(w), len(hit), sorted(found)))
    got = decontam.contamination(odd, items, block=block).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    assert any(x[2] for x in want)


def test_drop_contaminated(odd, items, nothing):
    ids = [r[0] for r in decontam.drop_contaminated(odd, items).select("doc_id").collect()]
    assert 18 not in ids and 3 not in ids and 0 in ids and None in ids
    assert decontam.drop_contaminated(odd, items.where("false")).count() == odd.count()
    assert decontam.contamination(nothing, items).count() == 0


def test_license_base_places(odd, texts):
    want = []
    for i, t in texts:
        w = words(t)
        hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want.append(((i is None, i or 0), len(w), sorted(hits)))
    got = licenses.license_scan(odd).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], sorted((h["s"], h["label"]) for h in r["base_hits"])) for r in got) == sorted(want)
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("under the GNU General Public License, version 2 or any later version", {"gpl-2-or-later"}),
        ("Apache License Version 2.0", {"apache-2.0"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("CC BY-NC 4.0", {"cc-by-nc-4.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("(c) Neither the name of the Example Foundation nor the names of its contributors may be used to endorse or promote products", {"bsd-3-clause"}),
        ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit or apache-2.0"}),
        ("no grant at all", set()),
    ],
)
def test_license_rules(spark, text, labels):
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {h["label"] for h in row["hits"]} == labels


def longest(pattern):
    """The most words that a pattern spans."""
    wide = re.sub(r"\(\?:\\w\+ \)\{\d+,(\d+)\}", lambda m: "x " * int(m[1]), pattern.replace(r"(?:\d{4} )+", "x x x x "))
    return len(wide.replace("(?= |\\z)", "").split(" "))


def test_license_rules_are_gated_and_bounded():
    assert len(licenses.RULES) >= 450
    assert all(longest(r.pattern) <= licenses.REACH for r in licenses.RULES)


def test_license_words_end_at_the_text_end(spark):
    got = licenses.license_scan(spark.createDataFrame([(1, "mit license\u0085"), (2, "mit license\n"), (3, "mit license\u2028")], "doc_id long, text string")).collect()
    assert [len(r["base_hits"]) for r in got] == [0, 1, 0]


COMPILED = [(r, re.compile(r.pattern.replace("\\z", "\\Z"))) for r in licenses.RULES]


def license_truth(text):
    """Every rule at every word, then suppression by its definition."""
    w = words(text)
    hits = []
    if set(w) & set(licenses.KEYWORDS):
        for k in range(len(w)):
            ahead = " ".join(w[k : k + licenses.REACH])
            for r, pattern in COMPILED:
                if m := pattern.match(ahead):
                    hits.append((k, k + len(m[0].split(" ")), r.label, r.priority, r.base))

    def beaten(d):
        own = d[1] - d[0]
        for o in hits:
            n = o[1] - o[0]
            if o[0] <= d[0] and o[1] >= d[1] and o[3] >= d[3] and (n > own or (n == own and (o[3] > d[3] or o[2] < d[2]))):
                return True
        return False

    return sorted(h[:3] for h in hits if h[4]), sorted(h[:3] for h in hits if not h[4] and not beaten(h))


def test_license_scan_against_brute_force(spark):
    rng = random.Random(12)
    plain = lambda p: re.sub(r"\{[^}]*\}|\\w\+|\(\?:|\(\?= \|\\z\)|[()^?+\\]", "", p).replace("|", " ")
    pool = [plain(r.pattern) for r in licenses.RULES]
    rows = []
    for k in range(150):
        parts = [rng.choice(pool) if rng.random() < 0.7 else " ".join(rng.choice(pool).split()[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 9))]
        rows.append((k, rng.choice([" ", ", ", " of the ", " 2 0 or later "]).join(parts).upper() if k % 5 == 0 else rng.choice([" ", "\n", " and "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "mit " * 200 + "license")]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labels = set()
    for k, text in rows:
        base, own = license_truth(text)
        assert sorted((h["s"], h["e"], h["label"]) for h in got[k]["base_hits"]) == base, text
        assert sorted((h["s"], h["e"], h["label"]) for h in got[k]["hits"]) == own, text
        labels |= {x[2] for x in own}
    assert len(labels) > 60


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\l\\h\\\\", "<turn>### user: x</turn>\n", "", None, ": a: b", "é\n\n\u0000"]
    rows = [(k % 3, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "od: d<#", None))]
    rows += [(None, 1, "user", "no id"), (7, None, "user", "no turn"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.withColumn("segments", F.lit(1))).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    want = defaultdict(list)
    for c, n, r, t in rows:
        want[c].append(((n is not None, n or 0), r or "", t or ""))
    assert len(out) == len(want)
    for r in out:
        turns = [(a, b) for _, a, b in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["read"]] == turns
        assert r["loss"] == "".join(b for a, b in turns if a == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])


@pytest.mark.parametrize(
    ("schema", "row", "turns"),
    [
        ("conv_id long, prompt string, response string", (1, "p", "r"), [("user", "p"), ("assistant", "r")]),
        ("conv_id long, instruction string, input string, output string", (1, "i", "", "o"), [("user", "i"), ("assistant", "o")]),
        ("conv_id long, instruction string, input string, output string", (1, "i", "x", "o"), [("user", "i\n\nx"), ("assistant", "o")]),
        ("conv_id long, messages array<struct<role:string,content:string>>", (1, [("User", "a"), ("assistant", None)]), [("user", "a"), ("assistant", "")]),
        ("conv_id long, conversations array<struct<from:string,value:string>>", (1, [("human", "a"), ("gpt", "b")]), [("user", "a"), ("assistant", "b")]),
        ("conv_id long, conversations array<struct<from:string,value:string>>", (1, None), []),
        ("conv_id long, prompt string, completion string, other int", (1, "p", "c", 3), [("user", "p"), ("assistant", "c")]),
    ],
)
def test_chat_layouts(spark, schema, row, turns):
    made = chat.canonical_turns(spark.createDataFrame([row], schema)).first()
    assert [(t["role"], t["text"]) for t in made["turns"]] == turns


def test_chat_of_records_with_mixed_layouts(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"}, {"completion": "c", "prompt": None}, {"question": "q", "answer": "a"}, {"system": "", "prompt": "p", "response": "r"},
        {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "output": "o"}, {"messages": [{"role": "human", "content": "x"}, {"content": "y", "role": "gpt"}]},
        {"conversations": [{"from": "human", "value": "x"}]}, {"turns": [{"role": "user", "text": "é"}, {"role": "model", "text": None}]}, {"prompt": "p"}, [], {"messages": []}, {"Prompt": "p", "Response": "r"},
    ]
    texts = [json.dumps(x) for x in records] + ["{", None, "1"]
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.mixed_turns(spark.createDataFrame(list(enumerate(texts)), "conv_id long, j string"), "j").collect()}
    want = [
        ("prompt_response", [("user", "p"), ("assistant", "r")]), ("prompt_completion", [("user", ""), ("assistant", "c")]), ("question_answer", [("user", "q"), ("assistant", "a")]),
        ("system_prompt_response", [("user", "p"), ("assistant", "r")]), ("instruction_input_output", [("user", "i"), ("assistant", "o")]), ("instruction_output", [("user", "i"), ("assistant", "o")]),
        ("messages", [("user", "x"), ("assistant", "y")]), ("conversations", [("user", "x")]), ("turns", [("user", "é"), ("assistant", "")]),
    ]
    assert [got[k] for k in range(9)] == want and all(got[k] == (None, []) for k in range(9, len(texts)))


def test_chat_of_very_long_and_of_no_texts(spark, nothing):
    df = spark.createDataFrame([(1, 0, "user", "x<#\\" * 100_000), (1, 1, "assistant", "y " * 200_000)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).first()
    assert out["read"][0]["text"] == "x<#\\" * 100_000 and out["loss"] == "y " * 200_000
    assert chat.format_chats(df.where("false")).count() == 0


def test_license_scan_of_an_empty_table(nothing):
    assert licenses.license_scan(nothing).count() == 0


def test_chat_of_an_unknown_layout(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, y string"))


@pytest.fixture(scope="module")
def spoken_mix(spark):
    rng = random.Random(11)
    own = {"en": "the of and weather theatre there".split(), "fr": "le la les était crème qué".split(), "de": "der die und über straße nicht".split()}
    both = "radio taxi hotel museum piano".split()
    rows = []
    for k in range(300):
        lang = ["en", "en", "en", "fr", "fr", "de"][k % 6]
        text = " ".join(rng.choice(own[lang] if rng.random() < 0.2 else both) for _ in range(rng.randrange(1, 25)))
        rows.append((k, text.upper() if k % 9 == 0 else text + " .", lang, None if k % 5 else "x"))
    rows += [(900, None, None, "x"), (901, "", "en", "x"), (None, "the of", "en", "y"), (902, "le la " * 20_000, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string").repartition(3)


def mixing_truth(rows, labelled, targets):
    """Posteriors and rates by a plain count and by projected gradient on all rates, run for very long."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    learnt = [r for r in rows if r["doc_id"] in labelled and r["lang"] is not None]
    domains = sorted({r["lang"] for r in learnt})
    counts = {d: Counter(w for r in learnt if r["lang"] == d for w in split(r["text"])) for d in domains}
    prior = np.array([sum(r["lang"] == d for r in learnt) / len(learnt) for d in domains])
    p = []
    for r in rows:
        w = split(r["text"])
        logs = [sum(np.log((counts[d][x] + mixing.SMOOTH) / (counts[d].total() + mixing.SMOOTH * mixing.BUCKETS)) for x in w) for d in domains]
        logs = np.array(logs) * min(1, mixing.EVIDENCE / max(1, len(w))) + np.log(prior)
        e = np.exp(logs - logs.max())
        p.append(e / e.sum())
    p, n = np.array(p), np.array([len(split(r["text"])) for r in rows], float)
    q = (n @ p) / n.sum()
    t = np.array([targets[d] for d in domains]) / sum(targets.values())
    rate = np.ones(len(rows))
    for _ in range(20_000):
        gap = (n * rate) @ p / n.sum() - t
        rate = np.maximum(0, rate - (p @ (gap / q) + mixing.KEEP * (rate - 1)) / (1 + mixing.KEEP))
    return p, n, rate


@pytest.mark.parametrize("targets", [{"en": 0.4, "fr": 0.3, "de": 0.3}, {"en": 1.0, "fr": 0.0, "de": 0.0}])
def test_mixing_against_a_plain_fit(spark, spoken_mix, targets):
    labels = spoken_mix.where("doc_id % 7 < 4 and doc_id < 900").select("doc_id").unionByName(spark.createDataFrame([(901,), (None,), (5000,)], "doc_id long"))
    out = mixing.mixed(spoken_mix, labels, targets)
    assert out.columns == ["doc_id", "text", "lang", "n_tokens", "domain", "domain_weight", "rate"]
    rows = out.collect()
    p, n, rate = mixing_truth(rows, {r["doc_id"] for r in labels.collect()} - {None}, targets)
    assert len(rows) == 306 and [r["n_tokens"] for r in rows] == n.tolist()
    assert np.allclose([r["domain_weight"] for r in rows], p.max(axis=1))
    assert [r["domain"] for r in rows] == [sorted(targets)[k] for k in p.argmax(axis=1)]
    got = np.array([r["rate"] for r in rows])
    assert (got >= 0).all()
    if min(targets.values()) > 0:  # else single rates creep on for thousands of rounds that move no share
        assert np.abs(got - rate).max() < 0.02
    held, wanted = (n * got) @ p / n.sum(), (n * rate) @ p / n.sum()
    assert np.abs(held - wanted).max() < 2e-3
    assert len({r["rate"] for r in rows if r["doc_id"] == 3}) == 1  # repeated rows


def test_mixing_rejects_unknown_targets(spoken_mix):
    with pytest.raises(ValueError, match="no labelled row"):
        mixing.mixed(spoken_mix, spoken_mix.select("doc_id"), {"xx": 1.0})


def test_drop_contaminated_goes_by_rows(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, f"so {ten} it is", "x"), (1, "clean", "y"), (None, ten, None), (None, "clean too", None), (None, None, None), (2, ten, "z"), (2, ten, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    got = decontam.drop_contaminated(docs, spark.createDataFrame([(7, ten)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_mixing_that_does_not_converge_is_an_error(spoken_mix, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="converge"):
        mixing.mixed(spoken_mix, spoken_mix.select("doc_id"), {"en": 0.2, "fr": 0.3, "de": 0.5})


def test_mixing_without_labels(odd, nothing, spark):
    none = spark.createDataFrame([], "doc_id long")
    assert mixing.classifier(odd, none) is None and mixing.classifier(nothing, none) is None
    out = mixing.mixed(odd, none)
    assert out.where("rate = 1.0").count() == odd.count()
    assert out.columns == [*[c for c in odd.columns if c not in mixing.MADE], *mixing.MADE]
    labels = odd.select("doc_id")
    assert mixing.mixed(nothing, labels).count() == 0 and mixing.mixed(odd, labels).count() == odd.count()


def test_mixing_of_empty_rows(odd):
    """Labelled rows, but no table to mix: the model stands, and nothing comes out."""
    m = mixing.classifier(odd, odd.select("doc_id"))
    placed = mixing.memberships(odd.where("false"), m)
    assert mixing.solve(placed, m).steps == []
