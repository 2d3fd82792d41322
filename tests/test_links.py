"""Relational operators on small fixtures: ties, nulls, cycles, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import names as N
from codequarry.operators import asof, graph, links, lookup, search
from codequarry.operators.lookup import all_pairs

D = "module string, function string, arity int, kind string, line int, file_path string, delegate_to string, delegate_as string, params string, seed string, payload string"
R = "module string, function string, line int, file_path string, kind string, payload string"


def defs(spark, *rows):
    """module, function, arity, kind, line, file and, for delegates, target and name."""
    return spark.createDataFrame([(*r, *([""] * (8 - len(r))), "", "x", "y") for r in rows], D)


def refs(spark, *rows):
    return spark.createDataFrame([(*r, "z") for r in rows], R)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def beh(spark):
    d = defs(
        spark,
        ("B", "", 0, "module", 1, "b.ex"), ("B", "cb", 1, "callback", 2, "b.ex"), ("B", "cb", 2, "callback", 3, "b.ex"), ("B", "cb", 1, "def", 9, "b.ex"),
        ("I", "", 0, "module", 1, "i.ex"), ("I", "cb", 1, "def", 5, "i.ex"), ("I", "cb", 2, "def", 6, "i.ex"), ("J", "", 0, "module", 20, "i.ex"), ("J", "cb", 1, "def", 22, "i.ex"),
        ("U", "", 0, "module", 1, "u.ex"), ("U", "cb", 1, "defp", 3, "u.ex"), ("N", "", 0, "defimpl", 1, "n.ex"),
    )
    r = refs(spark, ("B", "", 2, "i.ex", "behaviour"), ("B", "", 2, "u.ex", "use"), ("Other", "", 2, "u.ex", "use"), ("B", "", 2, "n.ex", "behaviour"))
    return d, r


def test_behaviours(beh):
    d, r = beh
    assert rows(asof.behaviour_implementors(d, r), "behaviour", "module") == [("B", "I"), ("B", "U"), ("Other", "U")]
    assert rows(links.behaviours_for_file(d, r), "file_path", "behaviour") == [("i.ex", "B"), ("n.ex", "B"), ("u.ex", "B")]
    assert rows(links.implementations(d, r), "module", "line") == [("B", 9), ("I", 5), ("U", 3)]
    found = rows(links.declarations(d, r), "module", "arity", "callback_line")
    assert found == [("B", 1, 2), ("I", 1, 2), ("I", 2, 3), ("J", 1, 2), ("U", 1, 2)]


def test_nearest_rows(spark):
    d = defs(
        spark,
        ("A", "", 0, "module", 1, "a.ex"), ("A", "f", 1, "def", 3, "a.ex"), ("A", "f", 2, "def", 3, "a.ex"), ("A", "t", 0, "type", 7, "a.ex"),
        ("P", "", 0, "defimpl", 8, "a.ex"), ("A.B", "", 0, "module", 10, "a.ex"),
    )
    probes = spark.createDataFrame([("a.ex", n) for n in (0, 1, 2, 3, 5, 7, 9, 10, 99)] + [("z.ex", 1), (None, 1), ("a.ex", None)], "file_path string, line int")
    found = {(r.file_path, r.line): r.enclosing_module for r in asof.enclosing_module(probes, d).collect()}
    assert [found["a.ex", n] for n in (0, 1, 9, 10, 99)] == ["", "A", "A", "A.B", "A.B"] and found["z.ex", 1] == "" and found[None, 1] == ""
    inside = {r.line: (r.caller_function, r.caller_arity, r.caller_line) for r in asof.enclosing_function(probes, d).collect()}
    assert 2 not in inside and inside[5] == ("f", 2, 3) and inside[7] == ("t", 0, 7)
    assert rows(asof.next_function_line(d), "line", "next_line") == [(3, 7), (7, 0)]
    assert rows(asof.function_ranges(d), "first_line", "last_line") == [(3, 6), (7, 506)]


def test_calls(spark):
    d = defs(spark, ("A", "", 0, "module", 1, "a.ex"), ("A", "f", 0, "def", 2, "a.ex"), ("A", "g", 0, "def", 6, "a.ex"), ("X", "y", 1, "type", 1, "x.ex"), ("X", "y", 1, "def", 9, "x.ex"))
    r = refs(spark, ("X", "y", 3, "a.ex", "call"), ("X", "y", 3, "a.ex", "call"), ("X", "y", 7, "a.ex", "call"), ("X", "", 7, "a.ex", "call"), ("X", "y", 1, "a.ex", "call"), ("X", "y", 900, "a.ex", "call"))
    assert rows(links.incoming_calls(d, r), "line", "caller_function") == [(3, "f"), (7, "g"), (900, "g")]
    out = links.outgoing_calls(d, r)
    assert rows(out, "caller_function", "n_calls", "first_call", "last_call", "target_line") == [("f", 2, 3, 3, 9), ("g", 1, 7, 7, 9)]


def test_delegates_follow_and_stop(spark):
    def dele(m, f, to, as_=""):
        return (m, f, 1, "defdelegate", 1, m + ".ex", to, as_)

    d = defs(
        spark, dele("A", "f", "B", "g"), dele("B", "g", "C"), ("C", "g", 1, "def", 1, "C.ex"), dele("L", "x", "L"), dele("M", "f", "Nowhere"),
        dele("H", "h", "C", "g"), ("H", "h", 2, "def", 5, "H.ex"), *[dele(f"D{n}", "f", f"D{n + 1}") for n in range(8)], ("D8", "f", 1, "def", 1, "D8.ex"),
    )
    found = {(r.module, r.function): (r.target_module, r.target_function, r.n_hops) for r in graph.follow_delegates(d).collect()}
    assert found["A", "f"] == ("C", "g", 2) and found["L", "x"] == ("L", "x", 5) and found["M", "f"] == ("M", "f", 0)
    assert found["H", "h"] == ("H", "h", 0) and found["D0", "f"] == ("D5", "f", 5) and found["C", "g"] == ("C", "g", 0)


def test_closure_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "c")], "module string, used string")
    seeds = spark.createDataFrame([("c",), ("q",)], "seed string")
    assert rows(graph.reachable(spark, edges, seeds), "seed", "node", "depth") == [("c", "a", 2), ("c", "b", 1), ("c", "c", 0), ("c", "d", 1), ("q", "q", 0)]


def test_searches(spark):
    d = defs(
        spark, ("App.Users", "", 0, "module", 1, "a.ex"), ("App.Users", "list_users", 0, "def", 2, "a.ex"), ("App.Users", "list_users", 0, "def", 3, "a.ex"),
        ("App.Users", "hide", 0, "defp", 4, "a.ex"), ("app.usersx", "", 0, "module", 1, "b.ex"), ("App.Users.Role", "", 0, "defimpl", 1, "c.ex"), ("App", "", 0, "module", 1, "d.ex"),
    )
    assert [(r["rank"], r.module, r.line) for r in search.search_symbols(d, "App.Users").orderBy("rank", "module", "line").collect()][0] == (0, "App.Users", 1)
    assert {r["rank"] for r in search.search_symbols(d, "Users").collect()} == {1, 2}
    assert search.search_symbols(d, "").count() == 0 and search.search_symbols(d, "list", "a.e").count() == 0
    assert search.search_symbols(d, "listXusers".replace("X", "_")).count() == 2
    assert rows(search.module_functions(d, True), "function", "line") == [("list_users", 2)] and search.module_functions(d, False).count() == 2
    pre = spark.createDataFrame([("app.u",), ("zz",)], "prefix string")
    assert rows(search.search_modules(d, pre), "prefix", "module", "position") == [("app.u", "App.Users", 1), ("app.u", "app.usersx", 2)]
    assert search.search_modules(d, pre.limit(0)).count() == 0
    assert rows(search.submodule_segments(d, spark.createDataFrame([("App",)], "parent string")), "segment") == [("Users",), ("usersx",)]
    seg = spark.createDataFrame([("users",), ("App",)], "segment string")
    assert rows(search.search_modules_by_suffix(d, seg), "segment", "module") == [("App", "App"), ("users", "App.Users")]


def test_rename_collisions(spark):
    d = defs(spark, ("A", "", 0, "module", 1, "a.ex"), ("A.B", "", 0, "module", 2, "a.ex"), ("N.B", "", 0, "module", 1, "n.ex"), ("N", "", 0, "module", 9, "a.ex"))
    names = spark.createDataFrame([("A", "N")], "old_prefix string, new_prefix string")
    assert rows(links.rename_map(d, names), "old_module", "new_module") == [("A", "N"), ("A.B", "N.B")]
    assert rows(links.rename_collisions(d, names), "new_module", "file_path") == [("N.B", "n.ex")]


def test_types_after_functions(spark):
    d = defs(spark, ("A", "x", 0, "type", 1, "a.ex"), ("A", "x", 0, "def", 5, "a.ex"), ("A", "y", 0, "opaque", 2, "a.ex"))
    assert rows(links.functions_over_types(d), "function", "kind") == [("x", "def"), ("y", "opaque")]
    keys = spark.createDataFrame([("A", "x"), ("A", "x"), (None, "x")], "module string, function string")
    assert [r.line for r in lookup.lookup_function(d, keys).collect()] == [5, 1]


def test_injector_and_dedup(spark):
    r = refs(spark, ("I", "f", 1, "a.ex", "call"), ("M", "f", 1, "a.ex", "call"), ("M", "f", 1, "stdlib/a.ex", "call"))
    inj = spark.createDataFrame([("M", "f", "I"), ("M", "f", "I")], "module string, function string, injector string")
    assert rows(links.injected_references(r, inj), "module", "injector", "line") == [("M", "I", 1)]
    assert rows(links.dedup_locations(r, ["function"], "stdlib/"), "function", "file_path") == [("f", "a.ex")]
    stored, seen = (spark.createDataFrame(x, "path string") for x in ([("a",), ("b",), ("b",)], [("a",), (None,)]))
    assert rows(links.missing_paths(stored, seen), "path") == [("b",)]


def test_empty_tables(spark):
    d, r = spark.createDataFrame([], D), spark.createDataFrame([], R)
    for df in (links.incoming_calls(d, r), links.outgoing_calls(d, r), links.implementations(d, r), links.declarations(d, r), graph.follow_delegates(d),
               asof.function_ranges(d), search.module_functions(d), lookup.using_modules(d), links.reverse_delegate_references(d, r)):
        assert df.count() == 0
    assert tuple(links.index_totals(d, r).first()) == (0, 0, 0)


@pytest.mark.parametrize(
    "name,want",
    [("HTTPClient", "http_client"), ("UserID", "user_id"), ("A", "a"), ("MyApp", "my_app"), ("V2Api", "v2_api"), ("OAuth2", "o_auth2"), ("", ""), ("already_snake", "already_snake")],
)
def test_snake_case(spark, name, want):
    assert spark.range(1).select(N.camel_to_snake(F.lit(name)).alias("x")).first().x == want


def test_name_functions(spark):
    one = spark.range(1).select(
        N.conventional_path(F.lit("A.NewName"), F.lit("lib/old.exs")).alias("a"), N.call_text(F.lit("f"), F.lit("a,b"), F.lit(3)).alias("b"),
        N.call_text(F.lit("f"), F.lit("a"), F.lit(1), True).alias("c"), N.thousands(F.lit(1234567)).alias("d"), N.is_keyword(F.lit("fn")).alias("e"),
        N.dir_name(F.lit("x")).alias("f"), N.completion_label(F.lit("zzz")).alias("g"), N.is_source_file(F.lit("a.exs")).alias("h"),
    ).first()
    assert tuple(one) == ("lib/new_name.exs", "f(a, b, arg3)", "f()", "1,234,567", True, ".", "text", True)


def test_workspaces_are_taken_away(spark):
    from codequarry import storage
    from codequarry.session import clear_workspaces, workspace

    folder = workspace(spark, "here")
    spark.range(3).write.parquet(folder)
    assert storage.exists(spark, folder) and clear_workspaces(spark) >= 1
    assert not storage.exists(spark, folder) and clear_workspaces(spark) == 0


def test_a_hot_key_of_a_lookup_can_be_split(spark):
    """The function that holds a third of all references: its partition is split although the keys were made distinct."""
    from codequarry.operators.lookup import references

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("M"), F.col("id") % 400))
        r = spark.range(0, 60_000, 1, 6).select(hot.alias("module"), F.lit("f").alias("function"), F.concat(F.lit("p"), F.col("id")).alias("file_path"), F.col("id").cast("int").alias("line"), F.lit("call").alias("kind"))
        found = references(r, r)
        assert len(found.collect()) == 60_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_all_pairs_is_the_join_and_deals_a_hot_key(spark):
    left = spark.createDataFrame([("hot", n) for n in range(200)] + [("a", 1), ("none", 1), (None, 1)], "k string, x int")
    right = spark.createDataFrame([("hot", n) for n in range(300)] + [("a", 1), ("a", 2), ("other", 1), (None, 1)], "k string, y int")
    found = all_pairs(left, right, ["k"], cell=20)
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in left.join(right, "k").select("k", "x", "y").collect())
    dealt = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.6 * len(rows)


def test_functions_in_modules_shuffles_no_product(spark):
    # One module that defines a name many times and is imported by many: as many answers as the product.
    d = defs(spark, *[("Hot", "run", n % 2, "def", n, f"h{n}.ex") for n in range(30)], *[("Hot", f"f{n}", 1, "def", n, "h.ex") for n in range(9)], ("Cold", "run", 1, "def", 1, "c.ex"))
    scopes = spark.createDataFrame([(f"s{n}", "Hot") for n in range(20)] + [("s0", "Cold"), ("s0", "None")], "scope string, module string")
    names = spark.createDataFrame(
        [(f"s{n}", "run", -1) for n in range(19)] + [("s0", "run", 1)] + [("s19", f"f{n}", 1) for n in range(12)] + [("s19", "run", a) for a in (0, 7)],
        "scope string, function string, arity int",
    )
    found = lookup.functions_in_modules(d, scopes, names)
    got = rows(found, "scope", "module", "function", "arity", "kind", "line", "file_path")
    want = [(f"s{n}", "Hot", "run", k % 2, "def", k, f"h{k}.ex") for n in range(20) for k in range(30) if n < 19 or k % 2 == 0]
    assert got == sorted(want + [("s0", "Cold", "run", 1, "def", 1, "c.ex")] + [("s19", "Hot", f"f{n}", 1, "def", n, "h.ex") for n in range(9)])
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Project"  # nothing compares the join's rows
