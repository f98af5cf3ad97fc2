"""Chat formatting, pseudonyms, quality and vector search against plain versions."""

import datetime
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardpanel.llm import chat, posting_search
from wardpanel.llm.pii import Permuter, luhn_digit, pseudonymise, replace_values
from wardpanel.llm.posting_search import nearest
from wardpanel.llm.quality import FEATURES, add_score, fit, held_out, text_features, train

SF = "/root/testdata/sf0.01"


def test_layouts(spark):
    turns = [("user", "hi"), ("assistant", "yo")]
    records = [
        ({"messages": [{"role": r, "content": t} for r, t in turns], "extra": {"a": [1]}}, "messages", turns),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations", turns),
        ({"dialog": [{"speaker": "user", "text": "hi"}, {"speaker": "bot", "text": "yo"}]}, "dialog", turns),
        ({"prompt": "hi", "completion": "yo"}, "completion", turns),
        ({"prompt": "hi", "response": "yo", "system": "s"}, "response", [("system", "s"), *turns]),
        ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
        ({"instruction": "do", "input": "", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
        ({"question": "q", "answer": "a", "context": None}, "question", [("user", "q"), ("assistant", "a")]),
        ({"data": {"prompt": "hi", "response": "yo"}}, "nested", turns),
        ({"prompt": None, "completion": "yo"}, "completion", [("user", ""), ("assistant", "yo")]),
        ({"messages": [{"role": None, "content": None}, {"role": "user", "content": "<|im_end|>"}]}, "messages", [("", ""), ("user", "<|im_end|>")]),
        ({"other": 1}, None, None),
        ({"prompt": "a", "completion": "b", "answer": "c", "question": "d"}, None, None),
        ({"messages": []}, None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(90, None), (91, "{broken"), (92, "")]
    out = chat.format_chats(spark.createDataFrame(rows, "n int, record string")).select("n", "layout", "turns", "formatted", chat.read_turns(F.col("formatted")).alias("back"))
    got = {r.n: r for r in out.collect()}
    for i, (_, layout, want) in enumerate(records):
        assert got[i].layout == layout, i
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == want, i
        assert (got[i].back and [tuple(t) for t in got[i].back]) == want, i
    assert all(got[i].layout is None and got[i].formatted is None for i in (90, 91, 92))


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "<|", "\x10", "\x100", "\x10n", "\n", "é", "😀", "user", "assistant", "&lt;", "", " "]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "system", None, "odd\nrole<|"]), text, 1))
    rows += [(200, t, "assistant" if t % 2 else "user", "long " * 400, 1) for t in range(300)] + [rows[0], (201, 1, "assistant", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    out = chat.format_chats(chat.rows_to_records(df))
    read = out.select("conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    groups = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        groups[conv].append((turn, role, text or ""))
    got = {r.conv_id: r for r in read.collect()}
    assert set(got) == set(groups)
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv, parts in groups.items():
        parts.sort(key=lambda p: (low(p[0]), (p[1] is not None, p[1] or ""), p[2]))
        want = [(r or "", t) for _, r, t in parts]
        assert [tuple(t) for t in got[conv].back] == want
        assert got[conv].loss == "".join(t for r, t in want if r == "assistant")
        assert got[conv].formatted.count("<|im_start|>") == len(want) == got[conv].formatted.count("<|im_end|>")
        assert len(got[conv].loss_mask) == sum(r == "assistant" for r, _ in want)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_conversations_stay(spark):
    """A text beyond the JSON parser's limit of 20,000,000 characters; a JSON record of that size is an error, not null."""
    rows = spark.range(4).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 1, F.repeat(F.lit("long "), 4_200_000)).otherwise("hi").alias("text"))
    out = chat.format_chats(chat.rows_to_structs(rows))
    got = out.select("layout", F.size("turns").alias("n"), F.length("formatted").alias("chars"), F.element_at("loss_mask", 1)["length"].alias("learn")).first()
    assert got.layout == "messages" and got.n == 4 and got.learn == 21_000_000 and got.chars == 21_000_000 + 6 + 2 * (4 + 9) + 4 * 24
    with pytest.raises(Exception, match="too large"):
        chat.format_chats(chat.rows_to_records(rows)).select(F.length("formatted")).collect()


def test_layouts_of_structs(spark):
    """Structs give what their JSON gives."""
    data = {
        "messages array<struct<role:string,content:string>>, extra int": [([("user", "hi"), (None, None)], 1), ([], 2), (None, 3)],
        "conversations array<struct<from:string,value:string>>": [([("human", "hi"), ("GPT", "yo")],)],
        "prompt string, completion string, system string": [("hi", "yo", None), ("hi", "yo", "s"), ("hi", "yo", "")],
        "instruction string, input string, output string": [("do", "x", "y"), ("do", None, "y")],
        "data struct<prompt:string,response:string>": [(("hi", "yo"),)],
        "other int": [(1,)],
    }
    for schema, rows in data.items():
        structs = spark.createDataFrame(rows, schema).select(F.struct("*").alias("record"))
        both = [chat.format_chats(df).select("layout", "turns", "formatted").collect() for df in (structs, structs.select(F.to_json("record", {"ignoreNullFields": "false"}).alias("record")))]
        assert sorted(map(str, both[0])) == sorted(map(str, both[1])), schema


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return body + luhn_digit(body)


def test_permuter():
    perm = Permuter(b"k")
    for n in (2, 3, 10, 97, 1000, 4097):
        image = [perm.permute("x", v, n) for v in range(n)]
        assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))
        assert [perm.unpermute("x", v, n) for v in image] == list(range(n))
    assert [Permuter(b"other").permute("x", v, 1000) for v in range(50)] != [perm.permute("x", v, 1000) for v in range(50)]


def test_replace_values():
    rng = random.Random(6)
    perm = Permuter(b"k")
    good = {
        "card": [card(rng), "4111 1111 1111 1111", "4111-1111-1111-1111"], "email": ["a@b.co", "Jo.Do+x_1@mail7.example.com"], "phone": ["+1 (017) 555-7713", "+49 30 901820", "555-123-4567", "(212) 555-0100"],
        "ip": ["97.51.17.173", "8.8.8.8"], "date": ["1999-02-28", "31/12/2001", "05.06.1980"], "ssn": ["078-05-1120"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    }
    for kind, values in good.items():
        for v in values:
            for frame in ("{}", "see {}, ok", "x {}%%% y", "{}!!", "({}) end.", "{}###"):
                text, counts = replace_values(frame.format(v), perm)
                assert counts == {kind: 1}, (v, frame, text)
                new = text[len(frame.split("{}")[0]) : len(text) - len(frame.split("{}")[1])]
                assert new != v and len(new) <= len(v) + (8 if kind == "ip" else 0) and v not in text
                if kind != "ip":
                    assert re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", new))) == re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", v)))
                if kind == "card":
                    digits = re.sub(r"\D", "", new)
                    assert luhn_digit(digits[:-1]) == digits[-1]
                if kind == "date" and "-" in v:
                    datetime.date.fromisoformat(new)
    for text in ("", "no data", "1234567890123456", "2001-02-30", "999.1.1.300", "000-12-3456", "price 12.50 of 100", "v1.2.3", "a @ b", "CC BY-NC 4.0", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "DE00370400440532013000", "@" * 50):
        assert replace_values(text, perm) == (text, {}), text


def test_neighbours_do_not_hide_values():
    """Numbers and capitals on both sides of a value, which the patterns take in."""
    perm = Permuter(b"k")
    alone = lambda v: replace_values(v, perm)[0]
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]
    ibans = ["BE68 5390 0754 7034", "BE68539007547034", "ES9121000418450200051332", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]
    for value, kind in [(v, "card") for v in cards] + [(v, "iban") for v in ibans]:
        for frame in ("{} 123", "{} 12/27", "7 {}", "{} EUR", "{} BIC", "EUR {} EUROS", "AB12 {}", "{} X1 Y2", "no {} 9 EUR"):
            assert replace_values(frame.format(value), perm) == (frame.format(alone(value)), {kind: 1}), (value, frame)
    for card in cards:
        for other, kind in (("555-123-4567", "phone"), ("078-05-1120", "ssn"), ("1999-02-28", "date"), ("BE68 5390 0754 7034 EUR", "iban")):
            new = alone(other)
            assert replace_values(f"{card} {other}", perm) == (f"{alone(card)} {new}", {"card": 1, kind: 1}), (card, other)
    assert replace_values("1234567890123456 555-123-4567", perm) == ("1234567890123456 " + alone("555-123-4567"), {"phone": 1})
    assert replace_values("+49 30 901820 4111 1111 1111 1111", perm)[0].startswith("+49 ") and "30 901820" not in replace_values("+49 30 901820 4111 1111 1111 1111", perm)[0]


def test_dates_with_the_month_first():
    perm = Permuter(b"k")
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(d) for d in range(1500)]
    shown = {d.strftime(f) for d in days for f in ("%m/%d/%Y", "%d/%m/%Y")}
    new = {v: replace_values(v, perm) for v in shown}
    assert all(c == {"date": 1} and t != v and len(t) == 10 for v, (t, c) in new.items())
    assert len({t for t, _ in new.values()}) == len(shown)
    for v, (t, _) in new.items():
        first, second = int(t[:2]), int(t[3:5])
        assert (second > 12) == (int(v[3:5]) > 12) and datetime.date(int(t[6:]), *((first, second) if second > 12 else (second, first)))
    assert replace_values("31/31/2001 and 02/30/2001", perm) == ("31/31/2001 and 02/30/2001", {})


def test_pseudonyms_link_documents(spark, frame):
    rng = random.Random(8)
    number, mail = card(rng), "anna.b@x.example.org"
    rows = [(1, f"pay {number} now"), (2, f"{mail} and {number}"), (2, f"{mail} and {number}"), (3, None), (None, mail), (4, ""), (5, "w " * 200_000 + number)]
    out = pseudonymise(frame(rows), "key", counts_col="n")
    assert out.columns == ["doc_id", "text", "id", "v", "n"]
    got = sorted((r.doc_id or 0, r.text, r.n) for r in out.where("doc_id is null or doc_id != 3").collect())
    new_number, new_mail = got[1][1].split()[1], got[0][1]
    assert [g[2] for g in got] == [1, 1, 2, 2, 0, 1] and got[2] == got[3] and got[2][1] == f"{new_mail} and {new_number}" and got[5][1].endswith(" " + new_number)
    assert out.where("doc_id = 3").first().text is None
    assert pseudonymise(frame(rows).where("false"), "key").count() == 0


def test_no_planted_value_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shape = re.compile(r"[A-Za-z0-9.]+@[a-z0-9]+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{16}(?!\d)")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pseudonymise(docs, "key").collect()}
    sound = lambda v: not re.fullmatch(r"\d{16}", v) or luhn_digit(v[:-1]) == v[-1]
    octets = lambda v: not re.fullmatch(r"[\d.]+", v) or "." not in v or max(map(int, v.split("."))) < 256
    private = {i: [v for v in shape.findall(t) if sound(v) and octets(v)] for i, t in before.items()}
    assert sum(map(len, private.values())) > 20
    for i, text in before.items():
        assert (after[i] == text) == (not private[i]) or not private[i] and len(after[i]) == len(text)
        assert not [v for v in private[i] if v in after[i]]


def test_features():
    x = text_features([b"", b"One two. Three", b"AA!! AA!! AA!!", b"a | b | c\na | b | c", "été".encode(), b"\n\n"])
    named = {f: x[:, i] for i, f in enumerate(FEATURES)}
    assert x.shape == (6, len(FEATURES)) and np.isfinite(x).all()
    assert named["bang_share"][2] > 0.4 and named["repeated_neighbours"][2] == pytest.approx(2 / 3) and named["distinct_words"][2] == pytest.approx(1 / 3)
    assert named["bar_share"][3] > 0.2 and named["distinct_lines"][3] == 0.5 and named["digit_share"][1] == 0
    alone = np.concatenate([text_features([t]) for t in (b"", b"One two. Three", b"AA!! AA!! AA!!")])
    assert np.allclose(alone, x[:3])


def test_model_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, len(FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.9
    flat = fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    assert flat.score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]


def test_quality_held_out(spark, frame):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    got = add_score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got) and len(got) > 100
    assert np.mean([(r.score >= 0.5) == r.quality for r in got]) > 0.93
    odd = add_score(frame([(1, None), (1, ""), (None, "x"), (2, "w " * 300_000)]), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == 4
    assert add_score(docs.where("false"), model).count() == 0
    none = train(docs, labels.where("false"))
    assert add_score(docs.limit(3), none).first().score == 0.5


def brute_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 16:
            good.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(float))
    out = {}
    for q, own in good.items():
        if q % 20 == 0:
            scored = sorted((-max(float((a * b).sum()) for a in own for b in other), i) for i, other in good.items() if i != q)
            out[q] = scored[:k]
    return out


@pytest.mark.parametrize("spread", [1.0, 0.15])
def test_nearest(spark, spread, monkeypatch):
    monkeypatch.setattr(posting_search, "LIST_ROWS", 40)
    monkeypatch.setattr(posting_search, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 1500)] + spread * rng.normal(size=(1500, 16))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # one very common vector
    rows += [(None, rows[3][1]), (3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [1.0] * 5), (3100, []), (3120, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<float>, score double").repartition(4)
    got = defaultdict(list)
    for r in nearest(df, 10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 10)
    assert set(got) == set(want)
    found = total = 0
    known = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and len(v) == 16 and None not in v}
    for q, ranked in got.items():
        ranked.sort()
        assert [r for r, _, _ in ranked] == list(range(1, 11))
        assert [(-s, i) for _, i, s in ranked] == sorted((-s, i) for _, i, s in ranked)
        assert all(s == pytest.approx(float((known[q] * known[i]).sum()), abs=1e-12) for _, i, s in ranked)
        worst = -want[q][-1][0]
        found += sum(s >= worst - 1e-12 for _, _, s in ranked)
        total += 10
    assert found / total >= 0.9


def test_nearest_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert nearest(df.where("false")).columns == ["query_id", "rank", "vec_id", "score"] and nearest(df.where("false")).count() == 0


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(set)
    for r in nearest(spark.read.parquet(f"{SF}/embeddings.parquet")).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -9
        hits.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9

