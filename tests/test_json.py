import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.operators import drift, nested
from tracewright.plans.durable import cut
from tracewright.sources import jsonstream
from tracewright.sources.jsonstream import INVALID, events, soundness

_JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("ab.[é", min_size=0, max_size=3), x, max_size=4),
    max_leaves=25,
)


def _objects(v, path="", item="$", element=False):
    if isinstance(v, dict):
        if element:
            yield item, path
            item = path
        for k, x in v.items():
            yield from _objects(x, f"{path}.{k}" if path else k, item)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _objects(x, f"{path}[{i}]", item, True)


def _links(text):
    return [(up, owner) for _, up, owner, _, kind, _, _ in nested.record_triples(text, nested.Shape("", "$", "")) if kind == "object" and owner != "$"]


@settings(max_examples=200, deadline=None)
@given(_JSON)
def test_the_stream_agrees_with_a_tree(v):
    for text in (json.dumps(v), json.dumps(v, indent=1, ensure_ascii=False)):
        assert _links(text) == list(_objects(v))
        out, names = [], []
        for kind, name, value in events(text):
            if kind == "end":
                names.pop()
            else:
                assert (name is None) == (not names or names[-1] == "array")
                if kind in ("object", "array"):
                    names.append(kind)
                else:
                    out.append(value if kind == "string" else json.loads(value))
        assert not names and out == list(_leaves(v))


def _leaves(v):
    if isinstance(v, (dict, list)):
        for x in v.values() if isinstance(v, dict) else v:
            yield from _leaves(x)
    else:
        yield v


@settings(max_examples=200, deadline=None)
@given(_JSON, st.integers(0, 400))
def test_cut_off_texts_are_invalid(v, n):
    text = json.dumps({"a": v})
    assert soundness(text[: n % len(text)]) == INVALID
    assert not jsonstream._follows_the_grammar(text[: n % len(text)]) and jsonstream._follows_the_grammar(text)


@pytest.mark.parametrize("text", [None, "", " ", "{", "[1,]", '{"a":1,}', "01", "nul", "1 2", '"\n"', "NaN", "[1 2]", "{1:2}", "]", '{"a"}', "-Infinity", '["\\x"]', "{]", "[}", "1.", "[,1]"])
def test_invalid(text):
    assert list(events(text)) == []
    assert text is None or not jsonstream._follows_the_grammar(text)


def test_very_deep_and_repeated_names():
    assert len(list(events("[" * 50_000 + "]" * 50_000))) == 100_000
    assert list(events("[" * 50_000 + "]" * 49_999)) == []
    assert [e[1:] for e in events('{"a":[{"b":1}],"c":2,"a":3, "c":{"d":1,"d":"\\u0041"}}')][1:-1] == [("a", "3"), ("c", None), ("d", "A"), (None, None)]
    assert list(events("1" * 9000)) == [("number", None, "1" * 9000)]


def test_tables(spark):
    doc = {"g": [{"n": "x", "r": [1, 2], "k": {"z": None}}, {"n": None, "r": ['a"b', None], "kids": [{"v": 1.5}, {}]}, {"r": [3]}], "m": "q"}
    rows = [(1, json.dumps(doc), "f"), (2, None, "f"), (3, "{", "f"), (4, '{"g":[]}', "f")]
    df = spark.createDataFrame(rows, "id long, text string, field string")
    assert "field_" in nested.triples(df, "text", ["id", "field"]).columns
    every = nested.tables(df, "text", ["id"])
    assert {k: v.columns[3:] for k, v in every.items()} == {"$": ["g", "m"], "g": ["k.z", "n", "r"], "g.kids": ["v"]}
    g = [tuple(r) for r in every["g"].select("id", "child_path", "parent_path", "n", "r", "`k.z`").orderBy("child_path").collect()]
    assert g == [(1, "g[0]", "$", "x", "[1,2]", None), (1, "g[1]", "$", None, '["a\\"b",null]', None), (1, "g[2]", "$", None, "[3]", None)]
    assert [tuple(r) for r in every["$"].orderBy("id").collect()] == [(1, "$", None, None, "q"), (4, "$", None, "[]", None)]
    kids = [tuple(r) for r in every["g.kids"].orderBy("child_path").collect()]
    assert kids == [(1, "g[1].kids[0]", "g[1]", "1.5"), (1, "g[1].kids[1]", "g[1]", None)]
    assert nested.flat(df.limit(0), "text", ["id"]).count() == 0 and nested.tables(df.limit(0), "text", ["id"]) == {}


def test_triples_and_their_pivot(spark):
    doc = {"g": [{"n": "x", "r": [[1, 2], []]}, {"n": "y", "o": {"p": [], "q": None}}], "m": [1, {"x": 1}]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id long, text string")
    got = [tuple(r)[1:] for r in nested.triples(df, "text", ["id"]).orderBy("ordinal").collect()]
    assert got == [
        ("$", None, "$", "", 0, "object", None, False), ("g", "$", "g[0]", "", 3, "object", None, False), ("g", "$", "g[0]", "n", 4, "string", "x", False),
        ("g", "$", "g[0]", "r", 7, "number", "1", True), ("g", "$", "g[0]", "r", 8, "number", "2", True), ("g", "$", "g[0]", "r", 9, "array", "[]", True),
        ("g", "$", "g[1]", "", 10, "object", None, False), ("g", "$", "g[1]", "n", 11, "string", "y", False), ("g", "$", "g[1]", "o.p", 13, "array", "[]", False),
        ("g", "$", "g[1]", "o.q", 14, "null", "null", False), ("$", None, "$", "m", 16, "number", "1", True),
        ("m", "$", "m[1]", "", 17, "object", None, False), ("m", "$", "m[1]", "x", 18, "number", "1", False),
    ]
    assert {r["table_path"] for r in nested.triples(df, "text", ["id"], ["g"]).collect()} == {"g"}
    flat = {r["child_path"]: r["fields"] for r in nested.flat(df, "text", ["id"]).collect()}
    assert flat == {"$": {"m": "[1]"}, "g[0]": {"n": "x", "r": "[[1,2],[]]"}, "g[1]": {"n": "y", "o.p": "[]", "o.q": None}, "m[1]": {"x": "1"}}
    assert {r["child_path"] for r in nested.flat(df, "text", ["id"], ["g"]).collect()} == {"g[0]", "g[1]"}


def test_flat_rows_of_long_records_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(nested, "FLUSH", 7)
    doc = {"g": [{"i": i, "k": [{"j": j} for j in range(3)]} for i in range(50)]}
    df = spark.createDataFrame([(1, json.dumps(doc), "f"), (2, json.dumps(doc), "f")], "id long, text string, fields string")
    got = nested.flat(df, "text", ["id", "fields"])
    assert got.columns == ["id", "fields_", "table_path", "parent_path", "child_path", "fields"]
    assert got.count() == 2 * (1 + 50 + 150) and got.where("table_path = 'g.k'").select("parent_path").distinct().count() == 50
    deep = spark.createDataFrame([(json.dumps({"s": [[1, 2], [], [["é"], 3]], "o": [1, {"x": 1}, [2]], "e": [[{"y": 2}]]}),), ("5",), ('[{"a":1}]',)], "t string")
    fields = [(r["table_path"], r["child_path"], r["fields"]) for r in nested.flat(deep, "t", []).collect()]
    assert sorted(fields, key=str) == sorted(
        [("$", "$", {"s": '[[1,2],[],[["é"],3]]', "o": "[1,[2]]"}), ("o", "o[1]", {"x": "1"}), ("e", "e[0][0]", {"y": "2"}), ("$", "$", {"": "5"}), ("$", "$", {}), ("", "[0]", {"a": "1"})],
        key=str,
    )


def _files(spark, docs):
    rows = [(1, i, json.dumps(d) if not isinstance(d, str) and d is not None else d) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "s long, f int, p string")


def _history(df):
    return drift.history(drift.file_schemas(df, "p", "s", "f"))


def _changes(spark, docs):
    found = drift.changes(drift.migration_steps(_history(_files(spark, docs))))
    return sorted((r["file"], r["change_kind"], r["old_path"], r["new_path"]) for r in found.collect())


def test_changes(spark):
    base = {"e": [{"name": "fwd-1", "dur": 5.5, "args": {"mb": 1}}, {"name": "bwd-2", "dur": 7.25}], "w": "4"}
    renamed = {"e": [{"op_name": "fwd-3", "dur": 6.5, "args": {"mb_id": 3}}], "w": 4}
    gone = {"e": [{"op_name": "fwd-3", "dur": None, "note": "late one"}], "w": 4}
    assert _changes(spark, [base, base, renamed, gone, None, gone]) == [
        (2, "renamed", "e.args.mb", "e.args.mb_id"), (2, "renamed", "e.name", "e.op_name"), (2, "retyped", "w", "w"),
        (3, "added", "", "e.note"), (3, "removed", "e.args", ""), (3, "removed", "e.dur", ""),
        (4, "removed", "e", ""), (4, "removed", "w", ""), (5, "added", "", "e"), (5, "added", "", "w"),
    ]
    v = drift.versions(drift.file_schemas(_files(spark, [base, base, renamed]), "p", "s", "f"))
    assert [r["version"] for r in v.orderBy("file").collect()] == [1, 1, 2]
    steps = drift.migration_steps(_history(_files(spark, [base, base, renamed, gone]))).orderBy("file", "step").collect()
    assert [tuple(r)[1:] for r in steps] == [
        (2, 1, 2, 1, "rename", "e.args.mb", "e.args.mb_id"), (2, 1, 2, 2, "rename", "e.name", "e.op_name"), (2, 1, 2, 3, "cast", "w", "number"),
        (3, 2, 3, 1, "default", "e.args", "null"), (3, 2, 3, 2, "default", "e.dur", "null"), (3, 2, 3, 3, "add", "e.note", "string"),
    ]
    assert _changes(spark, [base, {"e": 5}]) == [(1, "removed", "w", ""), (1, "retyped", "e", "e")]
    assert _history(_files(spark, [base]).limit(0)).count() == 0


def test_long_streams_are_compared_in_stripes(spark, monkeypatch):
    docs = [{"e": [{"a": i % 7, "b" if i // 5 % 2 else "c_b": "x"}]} if i % 11 else None for i in range(60)]
    df = _files(spark, docs).where("f NOT IN (3, 4, 17)").unionByName(_files(spark, docs[:9]).withColumn("s", F.lit(2).cast("long")))
    want = _history(df).select("stream", "file", "version", "steps").orderBy("stream", "file").collect()
    every = drift.versions(drift.file_schemas(df, "p", "s", "f")).orderBy("stream", "file").collect()
    for stripe in (1, 4, 13):
        monkeypatch.setattr(drift, "STRIPE", stripe)
        assert _history(df).select("stream", "file", "version", "steps").orderBy("stream", "file").collect() == want
        assert drift.versions(drift.file_schemas(df, "p", "s", "f")).orderBy("stream", "file").collect() == every


def test_profiles_do_not_depend_on_how_records_are_gathered(spark, monkeypatch):
    docs = [{"e": [{"a": i % 3, "n": f"w{i}", "t": "1.5", "ok": True, "k": {"z": None}, "q": []}, {"a": 1e400 if i == 3 else -i}], "w": "4"} for i in range(6)]
    df = _files(spark, docs).withColumn("f", F.col("f") % 2)
    want = sorted(drift.file_schemas(df, "p", "s", "f").collect(), key=str)
    monkeypatch.setattr(drift, "GATHERED", 1)
    assert sorted(drift.file_schemas(df, "p", "s", "f").collect(), key=str) == want
    a = {f["path"]: f for f in want[0]["fields"]}
    assert set(a) == {"e", "e.a", "e.n", "e.t", "e.ok", "e.k", "e.q", "w"} and (a["e.a"]["n"], a["e.a"]["lo"], a["e.n"]["words"], a["e.t"]["broken"], a["e.ok"]["logic"]) == (6, -4.0, 3, 3, 3)


def test_unlike_fields_are_not_renamed(spark):
    a = {"x": [{"dur_us": 5.5, "kind": "alpha"}]}
    b = {"x": [{"ts_us": 900000.5, "phase": "B"}]}
    assert {c[1] for c in _changes(spark, [a, b])} == {"added", "removed"}
    assert drift.affinity("kind", "phase") == 0
    assert drift.affinity("mb", "microbatch") and drift.affinity("worldSize", "world_sz") and drift.affinity("tid", "thread_id")


def _steady(df, carry, table, rest=None, apart=(), **limits):
    schemas = cut(drift.file_schemas(df, "p", "s", "f"))
    routed = cut(drift.routes(cut(drift.history(schemas))))
    records = drift.routed_records(df, "s", "f", schemas, routed)
    return drift.steady_table(records, "p", carry, "__moves", drift.steady_columns(routed, **limits), table, rest, apart)


def _routes(df):
    return {tuple(r)[:3]: (r["steady"], r["apart"]) for r in drift.routes(_history(df)).collect()}


def test_steady_table(spark):
    docs = [{"e": [{"name": "a", "dur": "5", "args": {"mb": 1}}]}] * 2 + [{"e": [{"op_name": "b", "dur": 6, "args": {"mb": "2"}}, {"op_name": None, "ok": True}]}] + [None, "{"]
    df = _files(spark, docs)
    assert _routes(df)[1, 2, "e.op_name"] == _routes(df)[1, 1, "e.name"] == ("e.name", False)
    out = _steady(df, ["f"], "e").orderBy("f", "child_path")
    assert out.columns == ["f", "parent_path", "child_path", "args_mb", "dur", "name", "ok"]
    assert [tuple(r)[3:] for r in out.collect()] == [(1.0, 5.0, "a", None)] * 2 + [(2.0, 6.0, "b", None), (None, None, None, True)]  # of two types in as many versions the first by name
    few = _steady(df, ["f"], "e", "rest", limit=5).orderBy("f", "child_path")  # the rarest columns are in the rest
    assert few.columns == ["f", "parent_path", "child_path", "args_mb", "dur", "name", "rest"] and few.collect()[-1]["rest"] == '{"ok":true}'
    assert _steady(df.limit(0), ["f"], "e", "rest").count() == 0


def test_streams_that_use_a_name_differently_keep_every_value(spark):
    """One stream renames a field to a name that another stream holds beside the first one."""
    one = [{"e": [{"dur_us": 5.5 + i, "k": "x"}]} for i in range(2)] + [{"e": [{"duration_us": 7.5, "k": "x"}]}]
    two = [{"e": [{"dur_us": 5, "duration_us": 500, "k": "x"}]}] * 2
    df = _files(spark, one).unionByName(_files(spark, two).withColumn("s", F.lit(2).cast("long")))
    r = _routes(df)
    assert r[1, 1, "e.dur_us"] == r[1, 2, "e.duration_us"] and not r[1, 1, "e.dur_us"][1]
    assert r[2, 1, "e.dur_us"] == ("e.dur_us", True) and r[2, 1, "e.duration_us"] == ("e.duration_us", True)
    out = _steady(df, ["s", "f"], "e", "rest").orderBy("s", "f").collect()
    assert [(x["dur_us"], x["duration_us"], x["rest"]) for x in out if x["s"] == 2] == [(5.0, 500.0, None)] * 2
    steady = r[1, 1, "e.dur_us"][0][2:]
    assert [x[steady] for x in out if x["s"] == 1] == [5.5, 6.5, 7.5]


def test_two_fields_that_swap_their_names_stay_two(spark):
    """By a third name, over several versions; each stays one field with its own values all along."""
    words = ["alpha", "beta", "gamma", "delta"]
    at = lambda x, y: {"e": [{x: 1000.5 + i, y: words[i]} for i in range(4)]}
    df = _files(spark, [at("left_end", "right_end"), at("mid_end", "right_end"), at("mid_end", "left_end"), at("right_end", "left_end")])
    r = _routes(df)
    number = [r[1, 1, "e.left_end"], r[1, 2, "e.mid_end"], r[1, 3, "e.mid_end"], r[1, 4, "e.right_end"]]
    word = [r[1, 1, "e.right_end"], r[1, 2, "e.right_end"], r[1, 3, "e.left_end"], r[1, 4, "e.left_end"]]
    assert number == [("e.right_end", True)] * 4 and word == [("e.left_end", True)] * 4
    out = _steady(df, ["f"], "e", "rest").orderBy("f", "child_path").collect()
    assert {r["rest"] for r in out} == {None} and [r["right_end"] for r in out] == [1000.5 + i for i in range(4)] * 4 and [r["left_end"] for r in out] == words * 4


def test_below_a_renamed_parent(spark):
    a, b = {"e": [{"args": {"mb": 1, "old": "x", "q": {"u": 1}}}]}, {"e": [{"args_map": {"mb_id": 2, "q": {"u": 2}}}]}
    c = {"e": [{"args_map": {"mb_no": 3, "q": {"u": 3}}}]}
    df = _files(spark, [a, a, b, c, c])
    assert [x[1:] for x in _changes(spark, [a, b, c])] == [("renamed", "e.args", "e.args_map"), ("renamed", "e.args_map.mb_id", "e.args_map.mb_no")]
    r = _routes(df)
    assert r[1, 1, "e.args.q.u"] == r[1, 3, "e.args_map.q.u"] and r[1, 2, "e.args_map.mb_id"] == r[1, 3, "e.args_map.mb_no"]
    out = _steady(df, ["f"], "e", "rest").orderBy("f").collect()
    assert [x[next(n for n in x.__fields__ if n.endswith("q_u"))] for x in out] == [1, 1, 2, 3, 3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "a.x", "b.x", "a.y", "b.y", "b.z", "c", "a.x.k", "b.y.k", "b.z.l"]), st.integers(1, 9)), max_size=9, unique_by=lambda x: x[0]))
def test_linked_names_share_their_class(paths):
    links = [("a", "b"), ("b.x", "b.y"), ("a.y", "a.z"), ("c", "d")]
    found = drift.classes_of(paths, links)
    assert {p for p, _ in paths} <= set(found)
    for a, b in links:
        assert found[a] == found[b]


def test_classes_by_joins_are_the_same(spark):
    paths = [("a", 3), ("b", 5), ("a.x", 1), ("b.x", 2), ("a.y", 4), ("b.z", 1), ("c", 1), ("a.x.k", 2), ("b.y.k", 2), ("b.z.l", 9), ("q", 2), ("n1", 1), ("n2", 1), ("n3", 1), ("n4", 7)]
    links = [("a", "b"), ("b.x", "b.y"), ("a.y", "a.z"), ("c", "d"), ("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("b.z.k", "b.z.l")]
    want = drift.classes_of(paths, links)
    got = drift._classes_by_joins(spark.createDataFrame(paths, "path string, n long"), spark.createDataFrame(links, "a string, b string"))
    assert {r["path"]: r["steady"] for r in got.collect()} == want
    df = _files(spark, [{"e": [{"name": "a", "k": 1}]}, {"e": [{"op_name": "b", "k": 1}]}])
    h = cut(_history(df))
    assert sorted(drift.routes(h, max_paths=0).collect()) == sorted(drift.routes(h).collect())


def test_steady_table_keeps_arrays_objects_and_what_does_not_fit(spark):
    docs = [{"e": [{"shapes": "[1]", "n": 1, "args": {"calls": [{"fn": "f", "line": 3}], "o": {}}}], "info": {"rank": 1, "groups": [{"ranks": [0, 1]}]}, "w": 2}] * 2
    docs += [{"e": [{"shapes": [[1, 2], []], "n": "x", "args": 7}, {"n": 2**60 + 1, "args": {"calls": []}}], "info": {"rank": "2", "groups": []}, "w": 3}]
    df = _files(spark, [docs[0], docs[2]]).unionByName(_files(spark, docs[:2]).withColumn("s", F.lit(2).cast("long"))).withColumn("f", F.col("s") * 10 + F.col("f"))
    out = _steady(df, ["f"], "e", "rest").orderBy("f", "child_path")
    assert out.columns == ["f", "parent_path", "child_path", "args", "args_calls", "args_o", "n", "shapes", "rest"]
    one = (None, '[{"fn":"f","line":3}]', "{}", 1.0, "[1]", None)
    assert [tuple(r)[3:] for r in out.collect()] == [
        one, ("7", None, None, None, "[[1,2],[]]", '{"n":"x"}'), (None, "[]", None, float(2**60), None, f'{{"n":{2**60 + 1}}}'), one, one
    ]
    root = _steady(df, ["f"], "", "rest", ("e",)).orderBy("f")
    assert root.columns == ["f", "parent_path", "child_path", "info_groups", "info_rank", "w", "rest"]
    one = (None, "$", '[{"ranks":[0,1]}]', 1.0, 2.0, None)
    assert [tuple(r)[1:] for r in root.collect()] == [one, (None, "$", "[]", 2.0, 3.0, None), one, one]


def test_steady_names_inside_arrays_and_two_fields_of_one_column(spark):
    types = {"e": "array", "e.a": "string", "e.k": "array", "e.k.y": "number"}
    moves = {"e.b": "e.a", "e.k.x": "e.k.y"}
    df = spark.createDataFrame([(json.dumps({"e": [{"a": "1", "b": "2", "k": [{"x": "5"}, {"x": 1, "y": None}, 3]}]}), moves)], "p string, m map<string,string>")
    out = drift.steady_table(df, "p", [], "m", types, "e", "rest")
    assert out.columns[2:] == ["a", "k", "rest"]
    assert tuple(out.first())[2:] == ("1", '[{"y":5},{"y":1,"y_":null},3]', '{"b":"2"}')


def test_every_object_has_its_steady_row(spark):
    from tests.oracle import SF
    from tracewright.queries import repair

    links = repair.p2_tables(spark, SF)
    for steady, table in ((repair.p6_events, "traceEvents"), (repair.p6_records, "$")):
        got = steady(spark, SF).select("record_id", "parent_path", "child_path")
        want = links.where(F.col("table_path") == table).select("record_id", "parent_path", "child_path")
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_registered_tables_hold_all_objects(spark):
    from tests.oracle import SF
    from tracewright.queries import repair

    links = repair.p2_tables(spark, SF).where("table_path <> '$'").select("record_id", "parent_path", "child_path")
    found = repair.p2_found(spark, SF)
    assert links.exceptAll(found).isEmpty() and found.exceptAll(links).isEmpty()
