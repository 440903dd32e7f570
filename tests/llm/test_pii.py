import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def sums(digits):
    d = [int(x) for x in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    """The contract's patterns as they stand."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sums(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@@..-_+ (0123456789é\n,")), max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "001.02.3.0255 256.1.1.1", "+1 (663) 555-6869 +12", "a@b a@b.c @x.y a@b.c@d.e", "a" * 200000 + "@", "9" * 200000, "1." * 50000, None, ""])
def test_base_by_hand(text):
    assert pii.base_spans(text) == brute(text) if text is None or len(text) < 1000 else pii.base_spans(text) is not None


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op10_personal_data(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        extra = [x for x in r.spans.split(",") if x.startswith("found:")]
        assert [x for x in r.spans.split(",") if x and x not in extra] == [x for x in base.split(",") if x]
        for x in extra:
            _, a, b = x.split(":")
            assert not any(s < int(b) and int(a) < e for s, _, e in want)


EDGES = "\"'`()[]{}<>,.;:!?#*$%&|=~"


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sightings(text):
    """(start, end, value, contexts, seed, base) of every value of a text, word by word."""
    words, base = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")], brute(text)
    out, taken = [], set()
    for a, _, b in base:
        i, j = (next(k for k, (x, y) in enumerate(words) if x <= p < y) for p in (a, b - 1))
        out.append((a, b, i, j, True))
        taken |= set(range(i, j + 1))
    for i, (x, y) in enumerate(words):
        body = text[x:y].strip(EDGES)
        if i not in taken and body:
            a = x + text[x:y].index(body)
            out.append((a, a + len(body), i, i, False))
    for a, b, i, j, is_base in out:
        word = lambda k: fold(text[words[k][0] : words[k][1]])
        contexts = [("before", [word(k) for k in range(max(0, i - 2), i)], fold(text[words[i][0] : a]))] if i else []
        contexts += [("after", fold(text[b : words[j][1]]), word(j + 1))] if j + 1 < len(words) else []
        value = fold(text[a:b])
        key = re.fullmatch("[a-z0-9+/_-]{32,}", value) and re.search("[a-z]", value) and len(re.findall("[0-9]", value)) >= 8
        yield a, b, value, [repr(c) for c in contexts], is_base or bool(key), is_base


def found_in(texts, rounds=pii.ROUNDS):
    """Spans of kind found of each text, by plain loops."""
    rows = [(t, *s) for t in set(texts) for s in sightings(t)]
    held = {}
    for _, _, _, value, contexts, _, _ in rows:
        for c in contexts:
            held.setdefault(c, set()).add(value)
    believed, trusted = {r[3] for r in rows if r[5]}, set()
    for _ in range(rounds):
        trusted = {c for c, v in held.items() if len(v & believed) >= pii.MIN_SUPPORT and len(v & believed) >= pii.MIN_TRUST * (len(v) + 0.25)}
        believed = believed.union(*(held[c] for c in trusted))
    return {t: sorted((a, b) for u, a, b, _, contexts, _, base in rows if u == t and not base and trusted & set(contexts)) for t in set(texts)}


def check_found(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = found_in(texts)
    for r in got:
        assert [(s.start, s.end) for s in r.spans if s.kind == pii.FOUND] == want[texts[r.doc_id]], texts[r.doc_id]
        assert [tuple(s) for s in r.spans if s.kind != pii.FOUND] == brute(texts[r.doc_id]) == [tuple(s) for s in r.base]
    assert len(got) == len(texts)
    return want


def test_found_spans_equal_brute_force(spark):
    """Names and values without digits, a chain of two rounds, keys in and out of trusted contexts, ordinary contexts."""
    texts = [f"lorem ipsum write to user{i}@mail.example.com today" for i in range(14)] + ["please Write  TO jane_doe@localhost today", "so write to\tMaria! today and"]
    texts += [f"log in as u{k} ok? then é (agent {k})" for k in range(3)]
    texts += [f"owner: \"{n}\" says" for n in ("jane_doe@localhost", "maria", "ann")] + [f"account of {n}; thanks" for n in ("ann", "bob")]
    texts += [f"the token = '{i:032x}12345678ab' here" for i in range(8)] + ["the token = 'swordfish' here", "the token = 'swordfish' here"]
    texts += ["see docs/guides/2024/getting-started/install-on-linux", f"commit {'ab12cd34' * 5} landed", f"a {'ab12cd34' * 5}"]
    texts += [f"in the {w} of" for w in ("house", "10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4", "street", "end")] + [None, "", " \n", "x", "write to", "+1 (523) 555-7040", "!!! ???", "long " * 30000]
    want = check_found(spark, texts)
    said = {t[a:b] for t, spans in want.items() for a, b in spans}
    assert {"jane_doe@localhost", "Maria", "swordfish"} <= said
    assert not said & {"house", "street", "docs/guides/2024/getting-started/install-on-linux", "ab12cd34" * 5}


def test_second_round(spark):
    """What the first round reveals vouches for contexts that no seed stands in."""
    texts = [f"mail to m{i}@x.example now" for i in range(12)] + [f"mail to {n} now" for n in ("amy", "ben")] + [f"login name {n} is" for n in ("amy", "ben")]
    texts += [f"mail to n{i}@y.example now" for i in range(12)] + ["mail to cat now"] + ["login name cat is", "login name dee is"] + [f"login name m{i}@x.example is" for i in range(3)]
    want = check_found(spark, texts)
    assert {t[a:b] for t, spans in want.items() for a, b in spans} == {"amy", "ben", "cat", "dee"}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a@b.c", "d@e.f", "g@h.i", "1.2.3.4", "x", "to", "'y'", "Z,", "é", "+1 (523) 555-7040", "=", "\n"]), max_size=9).map(" ".join), min_size=1, max_size=40))
def test_found_in_random_texts(spark, texts):
    check_found(spark, texts)


def test_found_in_the_table(spark, sf):
    check_found(spark, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_many_keys_are_joined(spark, monkeypatch):
    """Beyond the limit on what tasks are given, values and spans are joined to the contexts: the same spans."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("tidemark.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr("tidemark.llm.common.HEAVY", 3)
    check_found(spark, [f"write to u{i}@mail.example.com" for i in range(9)] + ["write to agent"] * 20)


def test_awkward_rows(spark):
    rows = [(None, None, "k"), (52, "", "k"), (52, "x", "k"), (1, "a@b.c", "k"), (1, "a@b.c", "k"), (None, "a@b.c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumnRenamed("spans", "base")
    got = [(r.doc_id, r.s) for r in pii.personal_data(docs).select("doc_id", pii.listed("spans").alias("s")).collect()]
    assert sorted(got, key=str) == sorted([(None, ""), (52, ""), (52, ""), (1, "email:0:5"), (1, "email:0:5"), (None, "email:0:5")], key=str)
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string, kind string")).count() == 0
