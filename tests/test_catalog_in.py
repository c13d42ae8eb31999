"""Product nodes in all forms of their nested lists."""

import json
from datetime import datetime
from decimal import Decimal

from commerce_lake.sources import catalog_in as C

FORMS = {
    "nodes": lambda rows, more: {"nodes": rows, "pageInfo": {"hasNextPage": more}},
    "edges": lambda rows, more: {"edges": [{"node": r} for r in rows] + [{"node": None}, {}], "pageInfo": {"hasNextPage": more}},
    "array": lambda rows, more: rows,
}
META = [
    {"namespace": "custom", "key": "size", "value": "S"}, {"namespace": "custom", "key": "size", "value": "M"}, {"namespace": "custom", "key": "list", "value": "[1]"}, {"namespace": "other", "key": "a", "value": "b"},
    {"namespace": "custom", "key": "n", "value": 3}, {"namespace": "custom", "key": None, "value": "x"},
]


def node(form, i, more=False, tags=("a", "b c")):
    make = FORMS[form]
    return {
        "id": f"p{i}", "title": "Tea, green", "tags": tags, "totalInventory": 7, "tracksInventory": "yes", "updatedAt": "2024-01-02T03:04:05Z", "combinedListingRole": "CHILD", "combinedListing": {"parentProduct": {"id": "p0"}},
        "featuredImage": {"url": "u", "altText": None}, "metafields": make(META, False), "collections": make([{"id": "c1"}, {"id": None}, {"id": "c2"}], more),
        "variants": make([{"id": "v1", "price": "1.50", "position": 1, "availableForSale": True}, {"id": "v2", "price": "free", "position": "2", "availableForSale": "true"}], more),
    }


def tables(spark, nodes):
    rows = spark.createDataFrame([(n if n is None or isinstance(n, str) else json.dumps(n),) for n in nodes], "node string")
    return [[r.asDict() for r in df.collect()] for df in C.normalize_products(rows)]


def test_all_forms_give_equal_rows(spark):
    p, v, m = tables(spark, [node(f, i) for i, f in enumerate(FORMS)])
    assert len(p) == 3 and len({json.dumps({k: x for k, x in r.items() if k != "gid"}, default=str, sort_keys=True) for r in p}) == 1
    one = p[0]
    assert one["tags"] == ["a", "b c"] and one["metafields"] == {"custom.size": "M", "custom.n": "3"} and (one["total_inventory"], one["tracks_inventory"]) == (7, None)
    assert (one["combined_role"], one["combined_parent_gid"], one["source_updated_at"], one["image_url"], one["image_alt"], one["handle"]) == ("CHILD", "p0", datetime(2024, 1, 2, 3, 4, 5), "u", None, None)
    assert sorted((r["product_gid"], r["variant_gid"], r["price"], r["position"], r["available_for_sale"]) for r in v if r["variant_gid"] == "v1") == [(f"p{i}", "v1", Decimal("1.50"), 1, True) for i in range(3)]
    assert {(r["price"], r["position"], r["available_for_sale"]) for r in v if r["variant_gid"] == "v2"} == {(None, None, None)}
    assert sorted((r["product_gid"], r["collection_gid"]) for r in m) == [(f"p{i}", c) for i in range(3) for c in ("c1", "c2")]


def test_cut_lists_comma_tags_and_faults(spark):
    odd = {"id": "q", "tags": 5, "variants": "none", "collections": None, "combinedListingRole": "NONE", "combinedListing": {"parentProduct": {"id": 9}}, "metafields": {"nodes": None}}
    nodes = [node("nodes", 1, more=True, tags=" x, ,y z ,"), node("edges", 2, more=True, tags=""), node("array", 3, more=True), odd, {"title": "no id"}, "{broken", "[1]", None, ""]
    p, v, m = tables(spark, nodes)
    by = {r["gid"]: r for r in p}
    assert sorted(by) == ["p1", "p2", "p3", "q"]
    assert by["p1"]["tags"] == ["x", "y z"] and by["p2"]["tags"] == by["q"]["tags"] == []
    assert [(by[g]["variants_complete"], by[g]["collections_complete"]) for g in ("p1", "p2", "p3", "q")] == [(False, False), (False, False), (True, True), (True, True)]
    assert (by["q"]["combined_role"], by["q"]["combined_parent_gid"], by["q"]["metafields"]) == (None, None, {}) and len(v) == 6 and len(m) == 6


def test_no_rows(spark):
    assert tables(spark, []) == [[], [], []]
