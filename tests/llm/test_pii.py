"""Personal data: plain and disguised identifiers, against brute force and against the SQL."""

import random
import re
import time
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from lintel.llm import pii
from lintel.llm.queries import ORACLE_SQL

CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "6304000000000000000", "4111111111111112"]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_brute(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_of_random_texts():
    rng = random.Random(6)
    parts = ["a", "@", ".", "b-", "@x.y", "1", "25", "256", "000", "1.2.3.4", "+", "(", ") ", " ", "-", "é", "😀", "\n", "4111111111111111", "a.b@c.de", *CARDS]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(k, b, e) for k, b, e, disguised, _ in pii.find(text) if not disguised] == base_brute(text), text


def said(text):
    return [(k, text[b:e], i) for k, b, e, disguised, i in pii.find(text) if disguised]


@pytest.mark.parametrize(
    "text, kind, source, identifier",
    [
        ("write bob at mail dot example dot com now", "email", "bob at mail dot example dot com", "bob@mail.example.com"),
        ("bob [at] mail (dot) com", "email", "bob [at] mail (dot) com", "bob@mail.com"),
        ("ana arroba correo punto es", "email", "ana arroba correo punto es", "ana@correo.es"),
        ("luc AROBASE poste point fr", "email", "luc AROBASE poste point fr", "luc@poste.fr"),
        ("bob@mail dot com", "email", "bob@mail dot com", "bob@mail.com"),
        ("é bоb@mаil.com", "email", "bоb@mаil.com", "bob@mail.com"),
        ("x bob＠site．com", "email", "bob＠site．com", "bob@site.com"),
        ("b​ob@si‍​te.com!", "email", "b​ob@si‍​te.com", "bob@site.com"),
        ("call plus one nine eight eight five five five two four eight five.", "phone", "plus one nine eight eight five five five two four eight five", "+19885552485"),
        ("+1 (988) 555‑2485", "phone", "+1 (988) 555‑2485", "+1 (988) 555-2485"),
        ("plus 1 (988) 555-2485", "phone", "plus 1 (988) 555-2485", "+1 (988) 555-2485"),
        ("four one one one, one one one one - " + "one " * 8, "card", None, None),
        ("four " + "one " * 14 + "one", "card", "four " + "one " * 14 + "one", "4111111111111111"),
        ("vier " + "eins-" * 14 + "EINS", "card", "vier " + "eins-" * 14 + "EINS", "4111111111111111"),
        ("ip one nine two dot one six eight dot one zero dot seven", "ip", "one nine two dot one six eight dot one zero dot seven", "192.168.10.7"),
        ("card ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111", "4111 1111 1111 1111"),
    ],
)
def test_disguised(text, kind, source, identifier):
    assert said(text) == ([(kind, source, identifier)] if source else [])


@pytest.mark.parametrize("text", ["look at example.com", "he was at home dot", "one of the two", "meet me at five", "a point at issue", "bob@mail.com, plus 3 more", "+1 (988) 555-7951 un", "Привет всем", "naïve café", "three point one four"])
def test_clean_texts_have_no_disguises(text):
    assert said(text) == []


def test_places_follow_many_edits():
    """Whatever stands around it, a disguised identifier maps back to its own characters."""
    rng = random.Random(2)
    hidden = ["bob at mail dot com", "bоb@mail.com", "b​ob (at) mail.com", "plus one two three four five six seven eight"]
    around = ["x", "é", "аб", "​​", " dot ", " seven eight ", "😀", "(at)", "plus 1", " ", ",", "(dot)", "zéro,un"]
    for _ in range(1500):
        before, own, after = ("".join(rng.choice(around) for _ in range(rng.randint(0, 9))) + " # ", rng.choice(hidden), " # " + "".join(rng.choice(around) for _ in range(4)))
        text = before + own + after
        assert (len(before), len(before) + len(own)) in [(b, e) for _, b, e, disguised, _ in pii.find(text) if disguised], text


def test_long_texts_take_one_pass():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "4 " * 500_000, "+1 " * 300_000, " " * 1_000_000, "a@" * 500_000, "one " * 200_000, "(at) " * 200_000, " at a" * 200_000, "а" * 1_000_000, "a​" * 200_000, "a@" + "b." * 500_000):
        pii.find(text)
    assert time.time() - began < 60


def test_scan(spark, docs, rows, empty):
    extra = [(900, "ask bob at mail dot com or ann@x.org", "en", None, None), (901, "+1 (988) 555-2485 and 10.0.0.1 and " + CARDS[0], "en", None, None), (900, "ask bob at mail dot com or ann@x.org", "en", None, None)]
    frame = docs.select("doc_id", "text", "size", "key").unionByName(spark.createDataFrame([(d, t, 1, "k") for d, t, *_ in extra], "doc_id long, text string, size long, key string"))
    got = Counter((r.doc_id, tuple(tuple(s) for s in r.spans)) for r in pii.scan(frame).collect())
    assert got == Counter((r[0], tuple(pii.find(r[1] or ""))) for r in [*rows, *extra])
    assert pii.scan(empty).collect() == []


def test_sql(spark, rows):
    rng = random.Random(12)
    parts = ["bob", " at ", "mail", " dot ", "com", "(at)", " [dot] ", "ann@x.org", "​", "о", "＠", " one", " two ", "un ", "zéro", "plus ", "+", "1", "1.2", ".3.4", " ", CARDS[0], CARDS[2], "4111 11", "é", "\n", "-", ", ", "seven dot eight dot nine dot two", "+1 (98", "8) 555-2485"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))) for i in range(1500)] + [(r[0], r[1]) for r in rows if not r[1] or len(r[1]) < 5000]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in texts], pa.int64()), "text": pa.array([t for _, t in texts], pa.string())}))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"]
    got = Counter(tuple(r) for r in pii.counted(pii.scan(spark.createDataFrame(texts, "doc_id long, text string"))).select(names).collect())
    want = Counter(con.sql(ORACLE_SQL["op11_pii"]).select(*names).fetchall())
    assert got == want
    assert sum(r[-1] for r in got) > 50
