"""Scanned pages: damage found and repaired on a small corpus."""

import pytest
from pyspark.sql import functions as F

from acequia.llm.scan_repair import find_damage, repair, skeleton

CLEAN = "Buscamos analista con manejo de sistemas. El perfil full-stack colabora con back-end y\nfront-end para revisar los informes semanales de cada grupo. Ofrecemos horario flexible y\nplena autonomía."
BAD = """Informe anual Acme SRL
Buscamos an@lista con manejo de sis-
temas. El perfil full-stack colabora con back-
end para revisar los inforrnes sema¬
Página 1 de 2
INF0RME ANUAL ACME SRL   2

nales de cada gru-
po. Ofrecemos horario flexlble y plena autonomía.
[2]"""


@pytest.fixture(scope="module")
def rows(spark):
    data = [("c", i, CLEAN) for i in range(30)] + [("d", 1, BAD), ("d", 2, None), ("d", 3, ""), ("d", 4, "Home\nJobs\nSign in"), ("d", 5, " \n ")]
    return spark.createDataFrame([(*r, 7) for r in data], "table_name string, ingest_seq bigint, text string, line_no int")


def test_damage(rows):
    got = {(r.line_no, r.kind) for r in find_damage(rows).collect() if r.table_name == "d"}
    assert got == {
        (0, "running_header"), (5, "running_header"), (4, "page_number"), (9, "page_number"), (1, "split_word"), (3, "split_word"), (7, "split_word"),
        (1, "misread"), (3, "misread"), (8, "misread"),
    }
    assert not [r for r in find_damage(rows).collect() if r.table_name == "c"]


def test_repair(rows):
    out = {(r.table_name, r.ingest_seq): r.text for r in repair(rows).collect()}
    assert out["d", 1] == (
        "Buscamos analista con manejo de sistemas. El perfil full-stack colabora con back-end para revisar los informes semanales de cada grupo. "
        "Ofrecemos horario flexible y plena autonomía."
    )
    assert out["d", 2] is None and out["d", 3] == "" and out["d", 4] == "Home\nJobs\nSign in" and len(out) == 35


def test_skeletons_level_confusions(spark):
    pairs = [("modern", "rnodern"), ("hasta", "liasta"), ("madera", "maclera"), ("nivel", "nlvel"), ("equipo", "eqiiipo"), ("servicio", "ser\\/icio"), ("plan", "pla†"[:3] + "n"), ("final", "ﬁnal"), ("cosa", "c0s@")]
    df = spark.createDataFrame(pairs, "a string, b string").select((skeleton(F.col("a")) == skeleton(F.col("b"))).alias("x"))
    assert all(r.x for r in df.collect())


def test_empty_table(rows):
    assert find_damage(rows.limit(0)).collect() == [] and repair(rows.limit(0)).collect() == []
