"""Small tables with known answers."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from commerce_lake.functions import privacy as P
from commerce_lake.functions import text as T
from commerce_lake.functions.stem import stem
from commerce_lake.operators import analytics as A
from commerce_lake.operators import bundles as BU
from commerce_lake.operators import documents as D
from commerce_lake.operators import intent as N
from commerce_lake.operators import merchandising as M
from commerce_lake.operators import restock as RS
from commerce_lake.operators import search as S
from commerce_lake.sources import events_in as I


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_damerau():
    assert [T.damerau(*p) for p in (("teh", "the"), ("recieve", "receive"), ("kitten", "sitting"), ("ca", "abc"))] == [1, 1, 3, 2]
    assert T.damerau("shoe", "shoelace", 2) == 3 and T.damerau("shoez", "shoes", 1) == 1


def test_stopwords(spark):
    rows = spark.createDataFrame([("red", "add", None), ("the", "remove", None), ("hot", "add", "fr")], "word string, mode string, locale string")
    words = {r.word for r in S.effective_stopwords(rows).collect()}
    assert "red" in words and "and" in words and not {"the", "hot"} & words
    q = spark.createDataFrame([(1, "red and the shoes"), (2, "and of")], "query_id int, query string")
    got = S.plan_tokens(q, S.effective_stopwords(rows)).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.token, r.n_tokens) for r in got] == [(1, "the", 2), (1, "shoes", 2), (2, "and", 2), (2, "of", 2)]


def test_stems():
    known = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit hopeful hope goodness good adjustment adjust adoption adopt probate probat rate rate controll control running run".split()
    assert [stem(w) for w in known[::2]] == known[1::2]


def test_text_columns(spark):
    v = lambda s: F.lit(s)
    assert one(spark, T.normalize_query(v("  Red,  SHOES!! "), True), T.tokenize(v("Red-Shoes 42"))) == ("red shoes", ["red", "shoes", "42"])
    assert one(spark, *[T.fuzzy_distance(v("x" * n)) for n in (1, 3, 4, 7, 8, 12)]) == (0, 0, 1, 1, 2, 2)
    assert one(spark, T.fold(v("Crème Brûlée")), T.tokenize(F.lit(None).cast("string"))) == ("creme brulee", [])
    assert one(spark, T.normalize_query(v("Ｆｕｌｌ width"))) == ("full width",)


def test_redaction(spark):
    texts = ["mail a.b@c.org now", "see https://x.y/z?q=1", "card 4111 1111 1111 1111", "call +49 (30) 123-4567", "key abcdefghij-klmnopqrst1", "size 42 only"]
    got = one(spark, *[P.redact(F.lit(t)) for t in texts])
    assert got == ("mail [redacted] now", "see [redacted]", "card [redacted]", "call [redacted]", "key [redacted]", "size 42 only")
    hidden = ["x@exämple.com", "josé.ñandú@mail.com", "০১২৩৪৫৬৭৮৯", "４１１１ １１１１ １１１１ １１１１", "a\u200b@b\u00ad.com", "ask ｍｅ＠ｘ．ｏｒｇ"]
    assert all("[redacted]" in x for x in one(spark, *[P.redact(F.lit(t)) for t in hidden]))
    assert one(spark, *[P.clean_query(F.lit(t)) for t in ("email a@b.com", "4111-1111-1111-1111", "  Red   SHOES  ", "my number is 9876543210", "123 main street")]) == ("email [redacted]", "[redacted]", "red shoes", "my number is [redacted]", "123 main street")
    assert one(spark, *[P.redact(P.redact(F.lit(t))) for t in texts]) == got
    assert one(spark, P.clean_query(F.lit("Red SHOES a@b.co")), P.clean_query(F.lit("  !! ")))[1] is None
    assert one(spark, *[P.safe_cell(F.lit(t)) for t in ("=1+1", " @x", "plain")]) == ("'=1+1", "' @x", "plain")
    assert one(spark, P.mask_email(P.normalize_email(F.lit(" Joe@Example.COM "))), P.normalize_email(F.lit("no at sign"))) == ("j***@e***.com", None)
    assert one(spark, *[P.safe_url(F.lit(u), ["x.org"]) for u in ("/a", "//a", "https://x.org/b", "https://y.org")]) == ("/a", None, "https://x.org/b", None)


def test_fnv_vector(spark):
    assert one(spark, M.fnv1a(F.lit("foobar")), M.assign_variant(F.lit("t"), F.lit("e"), F.lit(""), F.lit(50))) == (0xBF9CF968, "control")


def test_windows():
    now = datetime(2024, 1, 31, 12)
    assert A.resolve_window(None, None, now, 395) == (datetime(2024, 1, 2, 12), now)
    assert A.resolve_window("bad", "2024-01-10", now, 395)[0] == datetime(2024, 1, 2, 12)
    lo, hi = A.resolve_window("2024-01-20", "2024-01-10", now, 395)
    assert (hi - lo).days == 1
    assert A.rollup_days(now, date(2024, 1, 29)) == (date(2024, 1, 29), date(2024, 1, 30))
    assert A.rollup_days(now, None)[0] == date(2024, 1, 15)
    assert A.month_targets(datetime(2024, 12, 5)) == ["2024_12", "2025_01", "2025_02"]


def test_ab_verdicts(spark):
    s = spark.createDataFrame([("x", "A", 200, 20), ("x", "B", 200, 60), ("y", "A", 30, 3), ("y", "B", 30, 9)], "tenant_id string, variant string, searches long, clicks long")
    assert {r.tenant_id: r.verdict for r in A.compare_arms(s).collect()} == {"x": "significant", "y": "inconclusive"}


def test_discount(spark):
    got = one(spark, *[BU.bundle_discount(F.lit(s).cast("long"), F.lit(k), F.lit(v)) for s, k, v in ((1005, "percent", 50), (1000, "fixed_amount", 2000), (1000, "fixed_price", 700), (1000, "fixed_price", 1500))])
    assert got == (503, 1000, 300, 0)


def test_versions(spark):
    v = spark.createDataFrame([("t", 1, "superseded"), ("t", 2, "active"), ("t", 3, "validated"), ("t", 4, "building"), ("u", 1, "active")], "tenant_id string, version int, status string")
    status = lambda df: {(r.tenant_id, r.version): r.status for r in df.collect()}
    p = D.publish_version(v, "t", 3)
    assert status(p)["t", 3] == "active" and status(p)["t", 2] == "superseded" and status(p)["u", 1] == "active"
    assert status(D.publish_version(v, "t", 4)) == status(v)
    assert status(D.rollback_version(p, "t"))["t", 2] == "active"
    assert {r.version for r in D.prune_versions(v.where("tenant_id = 't'"), 1).collect()} == {2, 4}
    docs = spark.createDataFrame([("t", 4, "a"), ("t", 2, "b")], "tenant_id string, index_version int, product_id string")
    assert [r.product_id for r in D.recover_incomplete(v, docs)[1].collect()] == ["b"]


def test_intent(spark):
    ph = N.phrase_table(spark.createDataFrame([("vendor", "Acme"), ("vendor", "ACME"), ("product_type", "Running Shoes"), ("tag", "Red"), ("tag", "red"), ("tag", "odd"), ("tag", "Yellow")], "kind string, value string"), N.effective_attributes(spark, spark.createDataFrame([("Gold", "tag", "yellow"), ("", "tag", "x")], "phrase string, kind string, value string")))
    qs = ["red running shoes under $50", "up to 5 people", "from 1999", "from $1999 acme", "cheapest not red shoes", "around 10 sold out newest", "under 100ml", "under 1,0000", None, "up to 50 shoes", "up to 50 running shoes", "between 10 and $20 in stock", "over 5 under 9.99 acme", "without cotton shirt", "cotton shirt", "gold rush", "under 2 colors", "from 30", "up to $1,200.50 only", "less than 7usd"]
    r = N.extract_intent(spark.createDataFrame(list(enumerate(qs)), "query_id int, query string"), ph).orderBy("query_id").collect()
    assert (r[0].price_hi, r[0].type_any, r[0].tags_any, r[0].remaining) == (50.0, ["Running Shoes"], ["Red", "red"], "")
    assert [(x.price_lo, x.price_hi) for x in r[1:3]] == [(None, None)] * 2 and r[1].remaining == "up to 5 people"
    assert (r[3].price_lo, r[3].vendor_any) == (1999.0, ["ACME", "Acme"])
    assert (r[4].sort, r[4].negations, r[4].tags_any, r[4].remaining) == ("price_asc", ["red"], [], "shoes")
    assert (r[5].price_lo, r[5].price_hi, r[5].want_available, r[5].sort) == (8.0, 12.0, False, "newest")
    assert r[6].price_hi is None and r[7].price_hi is None and r[8].remaining == ""
    assert r[9].price_hi is None and r[10].price_hi == 50.0 and (r[11].price_lo, r[11].price_hi, r[11].want_available) == (None, None, True)  # "in" is a unit
    assert (r[12].price_lo, r[12].price_hi, r[12].vendor_any) == (5.0, 9.99, ["ACME", "Acme"])
    assert (r[13].negations, r[13].remaining, r[14].remaining, r[14].meta_any) == (["cotton"], "shirt", "cotton shirt", [])
    assert (r[15].tags_any, r[15].remaining) == (["Yellow"], "rush") and r[16].price_hi is None
    assert r[17].price_lo == 30.0 and (r[18].price_hi, r[18].remaining) == (1200.5, "only") and (r[19].price_hi, r[19].remaining) == (7.0, "")


def test_bulk_files(spark, tmp_path):
    rows = [
        {"id": "gid://store/Product/1", "title": "a", "tags": ["x"], "metafields": {"nodes": [{"namespace": "custom", "key": "k", "value": "v"}, {"namespace": "custom", "key": "l", "value": "[1]"}]}},
        {"id": "gid://store/ProductVariant/1", "__parentId": "gid://store/Product/1", "price": "1.50"}, {"id": "gid://store/ProductVariant/2", "__parentId": "gid://store/Product/9"},
        {"id": "gid://store/Collection/1", "__parentId": "gid://store/Product/1"}, {"id": "gid://store/Collection/1", "title": "c"},
    ]
    (tmp_path / "b.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    p, v, m = I.read_bulk_products(spark, str(tmp_path / "b.jsonl"))
    assert [(r.gid, r.metafields) for r in p.collect()] == [("gid://store/Product/1", {"custom.k": "v"})]
    assert [str(r.price) for r in v.collect()] == ["1.50"] and m.count() == 1 and I.read_bulk_collections(spark, str(tmp_path / "b.jsonl")).count() == 1
    assert I.count_bulk_products(I.read_bulk(spark, str(tmp_path / "b.jsonl"))) == 1
    with pytest.raises(ValueError):
        I.count_bulk_products(I.read_bulk(spark, str(tmp_path / "b.jsonl")).limit(0), 5)


def test_csv_and_properties(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1), ('say "hi"', 2)], "a string, b int")
    I.write_safe_csv(df.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert text == b"a,b\r\n'=x,1\r\n\"say \"\"hi\"\"\",2\r\n"
    cases = [
        {"ok": "v " * 200, "bad key": "x", "n": "a@b.org", "wide": "４１１１１１１１１１１１１１１１", "i": 7, "f": 1.5, "b": False, "nested": {"a": "a@b.org"}, "list": [1], "none": None},
        {f"k{i}": "x" * 100 for i in range(20)}, [1], "text", {},
    ]
    m = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(5, "{broken"), (6, None)], "i int, m string")
    got = {r.i: r.m for r in m.select("i", I.sanitize_properties(F.col("m")).alias("m")).collect()}
    first = json.loads(got[0])
    assert list(first) == ["ok", "n", "wide", "i", "f", "b"] and len(first["ok"]) <= 120 and first["n"] == first["wide"] == "[redacted]" and (first["i"], first["f"], first["b"]) == (7, 1.5, False)
    assert list(json.loads(got[1])) == [f"k{i}" for i in range(12)] and [got[i] for i in range(2, 7)] == ["{}", "{}", "{}", "{}", None]


def test_no_personal_data_is_stored(spark):
    event = {"eventType": "result_click", "surface": "search_page", "query": "Shoes for jo@mail.example or 4111 1111 1111 1111", "properties": {"q": "call +1 212 555 0100 or jo@mail.example", "deep": {"mail": "jo@mail.example"}}}
    raw = I.read_events(spark.createDataFrame([("t", datetime(2024, 1, 1), json.dumps(event))], "tenant_id string, occurred_at timestamp, json string"))
    clean, _ = I.validate_events(raw.drop("json"))
    modes = spark.createDataFrame([("t", "anonymous")], "tenant_id string, mode string")
    stored = I.ingest_events(clean, modes).first().asDict()
    assert "query" not in stored and stored["query_redacted"] and stored["query_norm"].startswith("shoes for [redacted]")
    assert not any(p in str(v) for v in stored.values() for p in ("@", "4111", "555"))


def test_redaction_against_plain_python(spark):
    """All texts of documents and conversations, and hostile ones, against the rules in plain Python."""
    import unicodedata

    import regex
    from conftest import SF

    rules = [regex.compile(p) for p in (r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}", r"(?i)(?a:\b)(?:https?://|www\.)[^\s\p{Z}\uFEFF]+", r"(?:\p{Nd}[ -]?){13,19}", r"\+?\p{Nd}(?:[ ().-]*\p{Nd}){6,}", r"(?a:\b)[A-Za-z0-9_-]{20,}(?a:\b)")]

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")
        t = "".join(str(ord(c) - z) if (z := next((z for z in P.DIGIT_ZEROS if z <= ord(c) < z + 10), None)) is not None else c for c in t)
        for r in rules:
            t = r.sub("[redacted]", t)
        return t

    extra = ["x@exämple.com", "٠١٢٣٤٥٦٧٨٩", "०१२३ ४५६ ७८९", "௦௧௨௩௪௫௬௭", "၀၁၂၃၄၅၆၇", "abc-def_ghi-jkl_mno-pqr", "ÄWWW.x.org www.y.org", "tel +49(30)1-2-3.4 5", "1" * 40, "", "a@b", "日本@例え.テスト", "née@é.fr, x"]
    texts = [r.text for n in ("documents", "conversations") for r in spark.read.parquet(f"{SF}/{n}.parquet").select("text").collect() if r.text] + extra
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in d.select("i", P.redact_text(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_normalised_queries_against_plain_python(spark):
    import unicodedata

    import regex
    from conftest import SF

    def plain(t):
        t = unicodedata.normalize("NFKC", regex.sub(r"[\x00-\x1f\x7f]", " ", t).lower())
        return regex.sub(" +", " ", regex.sub(r"[^\p{L}\p{N} ]", " ", t)).strip(" ")

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text] + ["Ｆｕｌｌ Ⅷ ﬁne", "ÀÉ\tx", "", "²³ ½", "Ünï-cödé"]
    d = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: r.x for r in d.select("i", T.normalize_query(F.col("t")).alias("x")).collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_events_are_validated_by_the_fixed_lists(spark):
    rows = ['{"eventType":"suggestion_click","surface":"predictive","sessionId":"a_1"}', '{"eventType":"bundle_add_to_cart","surface":"bundle","productGid":"gid://store/Product/7","resultCount":"1e8"}', '{"eventType":"bundle_click","surface":"bundle"}',
        '{"eventType":"result_click","surface":"search"}', '{"eventType":"result_click","surface":"redirect","who":1}', '{"eventType":"result_click","surface":"redirect","experimentId":"x"}', '{"eventType":"result_click","surface":"redirect","productGid":"gid://store/Product/123456789012345678901"}',
        '{"eventType":"filter_applied","surface":"search_page","experimentId":"0f8fad5b-d9cb-469f-a165-70867728950E","variant":"","position":-0.5}', '{"eventType":"filter_applied","surface":"search_page","sessionId":"","position":100000.9,"ts":5}', "[]", "x", None]
    raw = I.read_events(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, json string"))
    clean, rejected = I.validate_events(raw)
    assert sorted(r.i for r in clean.collect()) == [0, 1, 8] and rejected.count() == 9
    assert {(r.i, r.session_id, r.position) for r in I.validate_events(raw, session_allowed=False)[0].collect()} == {(0, None, None), (1, None, None), (8, None, 100000)}


def test_transitions(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("p", "", 1, t(1), False), ("p", "", 2, t(3), True), ("p", "", 3, t(2), False), ("p", "", 4, t(4), False), ("p", "", 5, None, True)]
    obs = spark.createDataFrame(rows, "product_id string, variant_key string, seq long, source_at timestamp, available boolean")
    assert [(r.seq, r.epoch) for r in RS.availability_transitions(obs).orderBy("seq").collect()] == [(2, 1), (5, 2)]


def test_plan_shapes(spark):
    from conftest import SF

    from commerce_lake.plans import QUERIES

    for name in ("search_batch", "similar", "build_cooccurrence", "attribute_carts"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    e = spark.read.parquet(f"{SF}/events.parquet")
    plan = A.purge_older_than(e, "ts", datetime(2024, 1, 31), 20).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_small_distance(spark):
    """Against the plain edit distance, on all pairs of short texts over two letters, and on edits of longer ones."""
    import itertools
    import random

    texts = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)]
    pairs = list(itertools.product(texts, texts))
    rnd = random.Random(7)
    for _ in range(1500):
        w = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9)))
        v = list(w)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(v) + 1)
            how = rnd.randrange(4)
            if how == 0:
                v.insert(i, rnd.choice("abcdé"))
            elif how == 1 and i < len(v):
                del v[i]
            elif how == 2 and i < len(v):
                v[i] = rnd.choice("abcdé")
            elif i + 1 < len(v):
                v[i], v[i + 1] = v[i + 1], v[i]
        pairs.append((w, "".join(v)))
    df = spark.createDataFrame([(*p, T.damerau(*p)) for p in pairs], "a string, b string, want int").withColumn("got", T.small_distance(F.col("a"), F.col("b")))
    wrong = df.where("not (got <=> if(want <= 2, want, null))").collect()
    assert not wrong and {0, 1, 2, 3} <= {r.want for r in df.select("want").distinct().collect()}
