"""Golden vectors of the scalar functions."""

import hashlib
import hmac
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions import normalize as N
from cloakframe.functions import pseudonyms as P
from cloakframe.functions import security as S
from cloakframe.functions import spans
from cloakframe.functions.rules import STANDARD, Rule
from cloakframe.operators import detect as D
from cloakframe.operators import resolve as R
from cloakframe.operators import sanitize as SZ


def test_detection(spark):
    rows = [("1", "Email synthetic@example.test; phone 13800138000; id 11010519491231002X."), ("2", "号11010519491231002X号"), ("3", "😀 a@b.co x"), ("4", "nothing"), ("5", None)]
    got = D.detect(spark.createDataFrame(rows, "block_id string, text string")).orderBy("block_id", "start_cp").collect()
    assert [(r.block_id, r.mention_type) for r in got] == [("1", "EMAIL"), ("1", "PHONE"), ("1", "ID_CARD"), ("2", "ID_CARD"), ("3", "EMAIL")]
    assert (got[-1].start_cp, got[-1].start_offset, got[-1].end_offset) == (2, 3, 9)
    both = [Rule("PHONE", "13800138000", confidence=0.98), Rule("EMAIL", STANDARD[0].pattern, confidence=1.0)]
    one = D.detect(spark.createDataFrame([("1", "13800138000@example.test")], "block_id string, text string"), both).collect()
    assert [(r.mention_type, r.start_cp, r.end_cp, r.confidence) for r in one] == [("EMAIL", 0, 24, 1.0)]
    for bad in (dict(pattern="a*"), dict(pattern=""), dict(pattern="a", confidence=2.0), dict(pattern="a", strength="NO")):
        with pytest.raises(ValueError):
            Rule("EMAIL", **bad)
    with pytest.raises(ValueError):
        Rule("SECRET", "a")


def test_matches_are_those_of_re(spark):
    texts = ["", "a@b.co", "x a@b.co, c@d.org a@b.co", "@", "é a@b.co😀z@y.xx."]

    @settings(max_examples=20, deadline=None)
    @given(st.lists(st.text(alphabet="ab@.co X1-é😀\n", max_size=30), min_size=20, max_size=20))
    def check(more):
        df = spark.createDataFrame([(t,) for t in texts + more], "text string")
        for row in df.select("text", spans.matches("text", STANDARD[0].pattern).alias("m")).collect():
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(STANDARD[0].pattern, row.text, re.ASCII)]
            assert [(m.start, m.end, m.value) for m in row.m] == want

    check()


def test_normal_forms(spark):
    rows = [
        ("PERSON", "  张   伟  ", "张 伟"),
        ("ORGANIZATION", "ＡＢＣ　科技  有限公司", "ABC 科技 有限公司"),
        ("EMAIL", "  Alice.Smith＠Example.COM ", "alice.smith@example.com"),
        ("PHONE", "+86 138-0013-8000", "13800138000"),
        ("PHONE", "+86 10 8888 6666", "861088886666"),
        ("ID_CARD", " 110101 19900307 123x ", "11010119900307123X"),
        ("BANK_ACCOUNT", "6222 0212 3456 7890", "6222021234567890"),
        ("CASE_NUMBER", " （2024） 京01民初  123号 ", "(2024) 京01民初 123号"),
    ]
    df = spark.createDataFrame(rows, "t string, raw string, want string")
    assert df.select("want", N.normalized(F.col("t"), F.col("raw")).alias("got")).filter("not want <=> got").collect() == []


def test_validity(spark):
    good = [("ID_CARD", "110101199003077774"), ("ID_CARD", "22020219850506321X"), *(("PHONE", p) for p in "13800138000 861088886666 12345 23800138000".split()), ("EMAIL", "synthetic@example.test"), ("BANK_ACCOUNT", "1" * 8), ("BANK_ACCOUNT", "1" * 30), ("PERSON", "x"), ("ADDRESS", "y")]
    cards = "123 1101011990030777X 11010119900307777x 11010119900307777A 11010119900307777X 110101199003077773 110101199013077770 110101199002307771 110101202903077771".split()
    bad = [*(("ID_CARD", c) for c in cards), ("PHONE", "1234"), ("PHONE", "1380013800a"), *(("EMAIL", e) for e in ("synthetic.example.test", "@example.test", "synthetic@", "a@b@c.test")), ("BANK_ACCOUNT", "1" * 7), ("BANK_ACCOUNT", "1" * 31), ("BANK_ACCOUNT", "1234 5678"), ("CASE_NUMBER", "x"), ("PERSON", ""), ("PERSON", None)]
    df = spark.createDataFrame([(t, v, True) for t, v in good] + [(t, v, False) for t, v in bad], "t string, v string, want boolean")
    wrong = df.select("t", "v", "want", N.valid(F.col("t"), F.col("v"), F.lit("2024-10-27").cast("date")).alias("got")).filter("want <> got").collect()
    assert wrong == []


def test_scoring(spark):
    cases = [
        ("PERSON", 0, 0, 1, 1, 1, 0.0, "CANNOT_LINK", ["USER_CANNOT_LINK"]),
        ("ID_CARD", 1, 1, 0, 0, 1, 0.0, "CANNOT_LINK", ["CONFLICTING_ID_CARD"]),
        ("PERSON", 0, 1, 1, 0, 1, 0.0, "CANNOT_LINK", ["CONFLICTING_ID_CARD"]),
        ("PHONE", 1, 1, 0, 0, 0, 40.0, None, ["SAME_PHONE"]),
        ("PERSON", 0, 0, 1, 0, 1, 40.0, "MUST_LINK", ["USER_MUST_LINK"]),
        ("ID_CARD", 1, 0, 0, 0, 0, 40.0, "MUST_LINK", ["SAME_ID_CARD"]),
        ("EMAIL", 1, 0, 0, 0, 0, 40.0, None, ["SAME_EMAIL"]),
        ("BANK_ACCOUNT", 1, 0, 1, 0, 0, 40.0, None, ["SAME_BANK_ACCOUNT"]),
        ("ORGANIZATION", 0, 0, 1, 0, 0, 25.0, None, ["NAME_EXACT"]),
        ("ADDRESS", 1, 0, 1, 0, 0, 0.0, None, []),
    ]
    names = ["shares", "conflicts", "name_exact", "user_cannot", "user_must"]
    df = spark.createDataFrame([(i, c[0], *map(bool, c[1:6])) for i, c in enumerate(cases)], "i int, mention_type string, " + ", ".join(f"{n} boolean" for n in names))
    got = [(r.score, r.hard_rule, [e.type for e in r.evidence]) for r in R.score(df).orderBy("i").collect()]
    assert got == [c[6:] for c in cases]


def test_decisions(spark):
    c = [  # mention, type, strength, candidates (entity, score, rule), wanted
        ("PERSON", "EXPLICIT", [("a", 100.0, None)], ("REVIEW", "a")),
        ("PERSON", "EXPLICIT", [("a", 1.0, "MUST_LINK")], ("AUTO_LINK", "a")),
        ("PERSON", "REFERENCE", [], ("UNRESOLVED", None)),
        ("PERSON", "EXPLICIT", [], ("NEW_ENTITY", None)),
        ("PERSON", "EXPLICIT", [("a", 1.0, "MUST_LINK"), ("b", 2.0, "MUST_LINK")], ("REVIEW", "b")),
        ("PERSON", "EXPLICIT", [("a", 100.0, "MUST_LINK"), ("a", 1.0, "CANNOT_LINK")], ("NEW_ENTITY", None)),
        ("PHONE", "EXPLICIT", [("a", 40.0, None)], ("UNRESOLVED", None)),
        ("ORGANIZATION", "EXPLICIT", [("a", 95.0, None), ("b", 70.0, None)], ("AUTO_LINK", "a")),
        ("ORGANIZATION", "EXPLICIT", [("a", 95.0, None), ("b", 85.0, None)], ("REVIEW", "a")),
        ("PERSON", "EXPLICIT", [("a", 25.0, None)], ("REVIEW", "a")),
        ("PERSON", "EXPLICIT", [("a", float("nan"), "MUST_LINK")], ("NEW_ENTITY", None)),
    ]
    m = spark.createDataFrame([(str(i), x[0], x[1]) for i, x in enumerate(c)], "id string, mention_type string, mention_strength string")
    rows = [(str(i), e, s, r, k, [f"l{k}"]) for i, x in enumerate(c) for k, (e, s, r) in enumerate(x[2])]
    cand = spark.createDataFrame(rows, "mention_id string, entity_id string, score double, hard_rule string, position int, labels array<string>")
    got = {r.mention_id: (r.decision, r.entity_id) for r in R.decide(m, R.rank(R.merge_candidates(cand))).collect()}
    assert [got[str(i)] for i in range(len(c))] == [x[3] for x in c]


def test_pseudonyms(spark):
    text = "Synthetic Name signed with Synthetic Name."
    df = spark.createDataFrame([(text,)], "text string")
    name = P.pseudonym(F.lit("Plaintiff A"), F.lit("@P-8K3F7A"))
    hits = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(s + 14).alias("end"), name.alias("value")) for s in (0, 27)])
    row = df.select(spans.splice("text", hits).alias("out"), spans.replacement_errors("text", hits).alias("bad")).first()
    assert row.out == "Plaintiff A〔@P-8K3F7A〕 signed with Plaintiff A〔@P-8K3F7A〕." and not row.bad
    for pairs in ([(0, 14), (13, 20)], [(5, 5)], [(0, 99)], [(-1, 3)]):
        h = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("x").alias("value")) for a, b in pairs])
        assert df.select(spans.replacement_errors("text", h)).first()[0]
    for alias, token in (("A", "not-a-token"), ("A〔b〕", "@P-1"), (" ", "@P-1"), ("a\nb", "@P-1")):
        assert df.select(P.pseudonym(F.lit(alias), F.lit(token))).first()[0] is None
    assert df.select(P.pseudonym(F.lit("A"), F.lit("@O-9Z2Y-1Q"))).first()[0] == "A〔@O-9Z2Y-1Q〕"


def test_restoring(spark):
    vault = {"@P-8K3F7A": ("Synthetic Name", ["Plaintiff A", "原告甲"]), "@P-1": ("v", ["A"]), "@P-2": ("w", ["Ann", "Old Ann"]), "@P-3": ("", ["A"]), "@P-4": ("bare", None)}
    cases = [
        ("Before Plaintiff A〔@P-8K3F7A〕 replied.", "Before Synthetic Name replied."),
        ("by @P-8K3F7A, too", "by Synthetic Name, too"),
        ("甲 原告甲〔@P-8K3F7A〕", "甲 Synthetic Name"),
        *((x, x) for x in ("x〔@O-NONE〕", "Plaintiff B〔@P-8K3F7A〕", "prefix@P-8K3F7Asuffix", "DATA〔@P-1〕", "A〔@P-3〕", "A〔@P-4〕", "no token", "", None)),
        ("Old Ann〔@P-2〕", "w"),
        ("😀 Ann〔@P-2〕 @P-1 A〔@P-1〕.", "😀 w v v."),
        ("@P-4", "bare"),
        ("A〔@P-1〕A〔@P-1〕", "vv"),
        ("Old Ann〔@P-1〕 @P-2 @P-2", "Old Ann〔@P-1〕 w w"),
    ]
    texts = spark.createDataFrame([("d", i, t) for i, (t, _) in enumerate(cases)] + [("e", 100, "by @P-8K3F7A")], "document_id string, i int, text string")
    targets = spark.createDataFrame([("d", k, v, a) for k, (v, a) in vault.items()], "document_id string, token string, value string, aliases array<string>")
    got = {r.i: r for r in SZ.rehydrate(texts, targets).collect()}
    assert {i: r.restored for i, r in got.items()} == {**{i: w for i, (_, w) in enumerate(cases)}, 100: "by @P-8K3F7A"}
    assert got[100].unresolved_tokens == ["@P-8K3F7A"] and got[0].unresolved_tokens == [] and got[3].unresolved_tokens == ["@O-NONE"]
    df = spark.createDataFrame([("a 〔@P-8K3F7A〕 @O-9Z2Y-1Q x@P-1y",)], "t string")
    assert df.select(P.token_references(F.col("t"))).first()[0] == ["@P-8K3F7A", "@O-9Z2Y-1Q"]


def _restored(text, targets):
    """What restoring gives, walked through letter by letter."""
    form = re.compile("〔(@[A-Z]-[A-Z0-9-]+)〕|(?<![A-Za-z0-9-])(@[A-Z]-[A-Z0-9-]+)(?![A-Za-z0-9-])", re.ASCII)
    out, done = "", 0
    for m in form.finditer(text):
        value, aliases = targets.get(m[1] or m[2], ("", ()))
        at = m.start()
        if m[1]:
            ends = [a for a in aliases if text[:at].endswith(a) and not re.search(r"[A-Za-z0-9]\Z", text[: at - len(a)], re.ASCII) or text[:at].endswith(a) and not re.match("[A-Za-z0-9]", a, re.ASCII)]
            if not ends or at - max(map(len, ends)) < done:
                continue
            at -= max(map(len, ends))
        if value:
            out, done = out + text[done:at] + value, m.end()
    return out + text[done:]


def test_restoring_against_a_walk(spark):
    targets = {"@P-1": ("one", ["A", "Big A", "甲"]), "@P-2": ("two", ["B", "x B"]), "@P-3": ("", ["A"])}
    vault = spark.createDataFrame([("d", k, v, a) for k, (v, a) in targets.items()], "document_id string, token string, value string, aliases array<string>")

    @settings(max_examples=10, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["A", "Big ", "甲", "B", "x ", "〔@P-1〕", "〔@P-2〕", "〔@P-3〕", "@P-1", " @P-2 ", "〔@P-9〕", " ", "〔", "〕", "z", "-"]), max_size=9).map("".join), min_size=25, max_size=25))
    def check(texts):
        df = spark.createDataFrame([("d", t) for t in texts], "document_id string, text string")
        for r in SZ.rehydrate(df, vault).collect():
            assert r.restored == _restored(r.text, targets), r.text

    check()


def test_keys_and_envelopes(spark):
    key = "07" * 32
    df = spark.createDataFrame([("m1", "张三"), ("m2", "张三"), ("m1", "")], "m string, v string")
    got = df.select("m", "v", S.fingerprint(S.matter_key(F.lit(key), F.col("m")), F.col("v")).alias("f")).collect()
    for row in got:
        mk = hmac.new(bytes.fromhex(key), f"matter-search:{row.m}".encode(), hashlib.sha256).digest()
        assert row.f == hmac.new(mk, row.v.encode(), hashlib.sha256).hexdigest()
    sealed = df.withColumn("e", S.sealed(F.col("v"), F.unhex(F.lit("09" * 32)), S.context(F.col("m"), "mention.text")))
    rows = sealed.collect()
    assert all(bytes(r.e[:2]) == b"\x01\x01" for r in rows) and len({bytes(r.e) for r in rows}) == 3
    back = spark.createDataFrame(rows)
    open_ = lambda e, field: S.opened(e, F.unhex(F.lit("09" * 32)), S.context(F.col("m"), field)).cast("string")
    ok = back.select("v", open_(F.col("e"), "mention.text").alias("a"), open_(F.col("e"), "matter.name").alias("b"), open_(F.concat(F.unhex(F.lit("0201")), F.expr("substring(e, 3)")), "mention.text").alias("c")).collect()
    assert all(r.a == r.v and r.b is None and r.c is None for r in ok)
    S.check_keys("09" * 32, key)
    for pair in ((key, key), ("07", key)):
        with pytest.raises(ValueError):
            S.check_keys(*pair)
    assert S.uuid7(5) < S.uuid7(6) and S.uuid7()[14] == "7"


def test_key_file(tmp_path):
    path = str(tmp_path / "keys.json")
    first = S.keys_from_file(path)
    assert first == S.keys_from_file(path) and first[0] != first[1] and os.stat(path).st_mode & 0o777 == 0o600
    for text in ("{", "[]", '{"version": 2}', f'{{"version": 1, "persistence": "{first[0]}", "search": "{first[0]}"}}', '{"version": 1, "persistence": "07", "search": "08"}'):
        with open(path, "w") as f:
            f.write(text)
        with pytest.raises(RuntimeError):
            S.keys_from_file(path)
    os.chmod(path, 0o644)
    with pytest.raises(RuntimeError, match="open to others"):
        S.keys_from_file(path)
