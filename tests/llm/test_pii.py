"""Personal details: spans, placeholders and surrogates."""

import pytest
from pyspark.sql import functions as F

from acequia.llm.pii import detect, find_spans, mask, mask_spans, surrogates

CASES = [
    ("Escribime a elena90@buzon.invalid.", [("email", "elena90@buzon.invalid")]),
    ("Escreva para oliver83 (arroba) equipo punto example. Fim", [("email", "oliver83 (arroba) equipo punto example")]),
    ("write to camila-olivarte [at] talento [dot] test.", [("email", "camila-olivarte [at] talento [dot] test")]),
    ("Mi celular es (011) 5550-1284.", [("phone", "(011) 5550-1284")]),
    ("WhatsApp +54 9 11 5551-1207 de 9 a 18.", [("phone", "+54 9 11 5551-1207")]),
    ("Consultas: rrhh@equipo.test o al (+55) 11 95551-5071.", [("email", "rrhh@equipo.test"), ("phone", "(+55) 11 95551-5071")]),
    ("Facturo con D.N.I. N° 94.044.857.", [("id_number", "94.044.857")]),
    ("My DNI: 93071336 is on file.", [("id_number", "93071336")]),
    ("Facturo con pasaporte ZZX109801.", [("id_number", "ZZX109801")]),
    ("Firmado: Garmuño, Nathan, CUIT 27980554610.", [("person_name", "Garmuño, Nathan"), ("id_number", "27980554610")]),
    ("Documento: CPF 997.295.703-43.", [("id_number", "997.295.703-43")]),
    ("Vivo en Pje. Corvalles 3214 dpto. 6 y me muevo.", [("address", "Pje. Corvalles 3214 dpto. 6")]),
    ("Interviews are held at Calle Hollin 3414, piso 6 D.", [("address", "Calle Hollin 3414, piso 6 D")]),
    ("La oficina queda en C/ Quintral, 49, 4º izq., a metros del parque.", [("address", "C/ Quintral, 49, 4º izq.")]),
    ("Estamos na calle velmira nro 747.", [("address", "calle velmira nro 747")]),
    ("Vivo en 1461 Ginkgo Ave y me muevo en bici.", [("address", "1461 Ginkgo Ave")]),
    ("Te entrevista Noelia Quendoza en Ginkgo 3565 (B9469XYZ).", [("person_name", "Noelia Quendoza"), ("address", "Ginkgo 3565 (B9469XYZ)")]),
    ("Gracias a PAULA ROSQUIDA y N. Belmarín por acompañar.", [("person_name", "PAULA ROSQUIDA"), ("person_name", "N. Belmarín")]),
    ("Hablé con João Ezparde Vertanga la semana pasada", [("person_name", "João Ezparde Vertanga")]),
]
NONE = [
    "Horario de 09:00-18:00, ref. 4971066039.", "Código de búsqueda 50956786.", "Expediente interno 6657-6657-6.", "Sueldo bruto de 2792.000 por mes.", "Presentamos Marta 2.0, nuestro asistente.",
    "Seguinos en @corvanta_9.", "Usamos la versión 5.2.12 del motor.", "Abrimos la avenida de crecimiento 6715 para perfiles junior.", "El proyecto Lucero Norte suma 5792 usuarios.",
    "Project Street 1213 shipped to 1213 users.", "Requisition 73322059, grade 4.", "Crecimos 11 57 puntos en 2025-2026.", "", "   ", None,
]


@pytest.mark.parametrize("text, want", CASES)
def test_spans(text, want):
    assert [(k, text[a:b]) for k, a, b in find_spans(text)] == want


@pytest.mark.parametrize("text", NONE)
def test_no_details(text):
    assert find_spans(text) == [] and mask_spans(text) == text


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["Soy Ana Ruiz. Escribime a ana.ruiz@buzon.example.", "Firmado: RUIZ, ANA, DNI 91.195.290.", "Firmado: Ruiz, Ana, DNI 92.195.290.", None, "", "nada " * 20000, "Soy Bruno Paz."]
    return spark.createDataFrame([("t", i, x, "k") for i, x in enumerate(texts)], "table_name string, ingest_seq bigint, text string, kind string")


def test_tables(spark, rows):
    spans = detect(rows).collect()
    assert {r.ingest_seq for r in spans} == {0, 1, 2, 6}
    masked = {r.ingest_seq: r.text for r in mask(rows).collect()}
    assert masked[0] == "Soy [PERSON]. Escribime a [EMAIL]." and masked[3] is None and masked[4] == ""
    assert detect(rows.limit(0)).collect() == []


def test_surrogates_keep_people_apart_and_together(spark, rows):
    out = {r.ingest_seq: r.text for r in surrogates(rows, b"secret").collect()}
    again = {r.ingest_seq: r.text for r in surrogates(rows, b"secret").collect()}
    other = {r.ingest_seq: r.text for r in surrogates(rows, b"else").collect()}
    assert out == again and out[0] != other[0] and out[3] is None and out[4] == ""
    given, sur = out[0].removeprefix("Soy ").split(".")[0].split()
    assert "Ana" not in out[0] and given.endswith("a")
    assert f"{sur.upper()}, {given.upper()}" in out[1] or f"{sur}, {given}" in out[2]
    ids = [out[i].split("DNI ")[1] for i in (1, 2)]
    assert all(len(x) == len("91.195.290.") and x[2] == x[6] == "." for x in ids) and ids[0] != ids[1]
    assert out[6].split()[1].rstrip(".") != given
    assert surrogates(rows.where(F.lit(False)), b"k").collect() == []


def test_surrogates_of_short_runs_are_distinct_and_not_real(spark):
    phones = [f"(011) 5550-{n}" for n in range(1000, 2500)] + [f"+54 9 11 5551-{n}" for n in range(1000, 1500)]
    ids = [f"91.195.{n}" for n in range(100, 999)]
    mails = [f"elena{n}@buzon.example" for n in range(10, 100)] + ["90@example.com", "test@example.com"]
    streets = [f"Calle Hollin {n}" for n in range(100, 900)]
    names = [f"{c}. Belmarín" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    groups = {"Mi celular es {}.": phones, "Firmado: DNI {}.": ids, "Escribime a {} hoy": mails, "Vivo en {}.": streets, "Firmado: {}, hoy": names}
    texts = [(group, value, group.format(value)) for group, values in groups.items() for value in values]
    rows = spark.createDataFrame([("t", i, x[2]) for i, x in enumerate(texts)], "table_name string, ingest_seq bigint, text string")
    out = {r.ingest_seq: r.text for r in surrogates(rows, b"secret").collect()}
    for group, values in groups.items():
        new = {out[i] for i, x in enumerate(texts) if x[0] == group}
        assert len(new) == len(values), group
        assert not new & {group.format(v) for v in values}, group


def test_a_number_is_the_same_however_it_is_grouped(spark):
    texts = ["Firmado: DNI 91.195.290.", "Firmado: DNI 91195290."]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "table_name string, ingest_seq bigint, text string")
    a, b = [r.text for r in surrogates(rows, b"secret").orderBy("ingest_seq").collect()]
    assert a != texts[0] and a.replace(".", "") == b.replace(".", "")


#: Names of many origins, none of them in the module's lists of given names.
UNLISTED = [
    "Rocío Benítez", "Matías Franco", "Priya Raghunathan", "Guadalupe Herrera", "Thiago Moreira", "Oluwaseun Adeyemi", "Kenji Tanaka", "Itzel Quispe", "Björn Sigurdsson", "Amara Okafor",
    "Iker Zubizarreta", "Yesenia Villalobos Prado", "Nahuel Ferreyra", "Siobhan Gallagher", "Zoe Papadopoulos", "Anselmo Della Torre", "Dmitri Volkov", "Leilani Kahale", "Fatou Diallo", "Ngozi Eze",
]
AROUND = ["Hoy hablé con {} sobre el turno.", "Please contact {} about the rota.", "Fale com {} até sexta.", "La reunión la coordina {} desde abril.", "Kind regards, {}", "My colleague {} will answer."]
NO_NAMES = ["Trabajo en Talleres Lumbre desde enero.", "Vivo en Villa Mercedes.", "We use Google Cloud every day.", "Our client Acme Robotics hires.", "About The Role", "Machine Learning and Data Science.", "Buscamos Analista Funcional Senior."]


def test_names_in_no_list():
    from acequia.llm.pii import GIVEN, _fold

    assert not {_fold(n.split()[0]) for n in UNLISTED} & set(GIVEN)
    cases = [(t.format(n), n) for n in UNLISTED for t in AROUND]
    hit = sum(any(k == "person_name" and x[a:b] == n for k, a, b in find_spans(x)) for x, n in cases)
    assert hit >= 0.9 * len(cases)
    assert [x for x in NO_NAMES if any(k == "person_name" for k, _, _ in find_spans(x))] == []


def test_streets_elsewhere_and_account_numbers():
    kinds = lambda x: [(k, x[a:b]) for k, a, b in find_spans(x)]
    assert kinds("Le bureau: 12 rue de Rivoli.") == [("address", "12 rue de Rivoli")] and kinds("Büro in der Friedrichstraße 12.") == [("address", "Friedrichstraße 12")]
    assert kinds("IBAN ES91 2100 0418 4502 0005 1332.") == []
