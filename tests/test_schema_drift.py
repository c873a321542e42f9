"""Schema drift: edit scripts, reported changes and the unified table."""

import itertools
import json
import random

from acequia.operators.schema_drift import _assign, edit_script, schema_changes, unified_records


def node(types="string", profile=None, children=None):
    return {"types": {types: 1}, "profile": profile or {1: 1}, "children": children or {}}


def test_assignment_against_brute_force():
    random.seed(3)
    for n in (1, 2, 3, 4, 5):
        for _ in range(20):
            m = [[random.randint(0, 20) for _ in range(n)] for _ in range(n)]
            best = min(sum(m[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            a = _assign(m)
            assert sorted(a) == list(range(n)) and sum(m[i][a[i]] for i in range(n)) == best


def test_rename_needs_like_content():
    old = {"a": node(profile={1: 9, 2: 1}), "k": node()}
    assert ("rename", "b", "a") in edit_script(old, {"b": node(profile={1: 8, 2: 1}), "k": node()})[1]
    script = edit_script(old, {"b": node(profile={7: 5}), "k": node()})[1]
    assert ("delete", "", "a") in script and ("add", "b", "") in script


def landed(spark, *files):
    rows, meta = [], []
    for no, feed, payloads in files:
        meta.append((no, f"f{no}", feed, "raw", "extra"))
        rows += [(no * 100 + i, no, i, p if isinstance(p, (str, type(None))) else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    r = spark.createDataFrame(rows, "raw_id bigint, file_no bigint, line_no int, payload string")
    return r, spark.createDataFrame(meta, "file_no bigint, origin_file string, feed_id bigint, kind string, payload string")


def people(n, **names):
    ks = {"title": "title", "company": "company", "id": "jobId"} | names
    return [{ks["title"]: f"Analista {t}", ks["company"]: f"{c} SRL", ks["id"]: 4000000000 + i} for i, (t, c) in enumerate(zip(["Java", "Go", "Vue", "PHP"] * n, ["Lumbre", "Taborda", "Miral"] * n))]


def changes(spark, *files):
    return sorted((r.file_no, r.field_name, r.change_kind, r.old_field) for r in schema_changes(*landed(spark, *files)).collect())


def test_all_kinds_of_change(spark):
    base = people(3)
    note = [p | {"nota": "Texto libre que no se parece a nada de lo anterior"} for p in people(3, id="jobid", title="puesto")]
    typed = [p | {"jobid": str(p["jobid"]), "company": {"name": p["company"], "slug": "x"}} for p in note]
    gone = [{k: v for k, v in p.items() if k != "nota"} for p in typed]
    assert changes(spark, (1, 0, base), (2, 0, note), (3, 0, typed), (4, 0, gone), (5, 1, people(3, id="idEmpleo"))) == [
        (2, "jobid", "renamed", "jobId"), (2, "nota", "added", ""), (2, "puesto", "renamed", "title"),
        (3, "company", "retyped", ""), (3, "jobid", "retyped", ""), (4, "nota", "removed", ""),
    ]


def test_unreadable_null_and_repeated_payloads(spark):
    base = people(2)
    bad = [*base, '{"title": "cut o', None, "", "[1]", "17", base[0], base[0] | {"nuevo": None}]
    assert changes(spark, (1, 0, base), (2, 0, bad)) == []


def test_file_order_is_by_number_and_feed(spark):
    a, b = people(2), [p | {"remote": True} for p in people(2)]
    assert changes(spark, (3, 7, b), (1, 7, a), (2, 8, b)) == [(3, "remote", "added", "")]


def test_empty_tables(spark):
    r, f = landed(spark, (1, 0, people(1)))
    assert schema_changes(r.limit(0), f).collect() == []
    assert unified_records(r.limit(0), f, ["title"]).collect() == []


def test_unified_table_follows_renames(spark):
    first = people(2)
    later = [{"puesto": p["title"], "Empresa": {"name": p["company"], "slug": "s"}, "jobid": p["jobId"]} for p in first]
    r, f = landed(spark, (1, 0, first), (2, 0, later))
    out = unified_records(r, f, ["title", "companyName", "jobId", "text_ocr"]).collect()
    assert len(out) == len(first) * 2
    by = {}
    for x in out:
        by.setdefault(x.line_no, set()).add((x.title, x.companyName, x.jobId, x.text_ocr))
    assert all(len(v) == 1 and None not in next(iter(v))[:3] for v in by.values())
