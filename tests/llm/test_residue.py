"""Residue: messages, slots and texts that only write about them."""

import pytest

from acequia.llm.residue import find_residue, mine_templates, messages, without_residue

BODY = "Trabajamos con Java en un entorno nuevo. Ofrecemos horario flexible."
BAD = [
    "Hola {{first_name}}, tenemos una vacante.", "Puesto: ${title} en ${company}", "Thank you for applying to <%= puesto %>.", "Estimado/a %NOMBRE%:", "Hola @@FIELD_12@@, buscamos undefined",
    "Hi {0}, we have a NaN opening.", "Texto: [Nombre de la empresa]", "Lorem ipsum dolor sit amet.", "TODO: agregar requisitos", "Your text here.", "Internal Server Error - nginx upstream 3 timed out",
    "Acceso denegado.", "404 Página no encontrada", "Please enable JavaScript to view this page.", "Verificá que sos una persona para continuar.", '{"error":{"status":404,"message":"not available","id":9}}', "Cargando…",
]
GOOD = [
    "En Vue mostramos datos con {{ variable }} y los probamos.", "Our templates print {{ user }} on the server, and tests cover it.", "Las vacantes [Remoto] y [CABA] cierran el viernes.",
    "El sueldo arranca en $1.500 y se revisa en marzo.", "Diseñamos páginas de error 404 amables para tiendas.", "Reemplazamos el texto lorem ipsum de los prototipos por contenido real.",
    "Access denied screens are part of your design brief.", "Buscamos a alguien que domine JavaScript y sepa activarlo en entornos cerrados.", "int main(){return 0;}",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, t in enumerate(BAD)] + [(100 + i, f"{BODY} {t}") for i, t in enumerate(BAD)] + [(200 + i, f"{BODY} {t}") for i, t in enumerate(GOOD)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, BODY * 400), (0, BAD[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, reason string")
    return df, sorted(r.doc_id for r in find_residue(df).collect())


def test_bad_alone_and_inside_records(found):
    assert found[1] == sorted([*range(len(BAD)), *range(100, 100 + len(BAD))])


def test_the_rest_is_kept(found):
    df, ids = found
    assert sorted({r.doc_id for r in without_residue(df).collect()}) == sorted([*range(200, 200 + len(GOOD)), 300, 301, 302, 303])


def test_templates_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"Código {i} del caso abierto por usuario{i}.") for i in range(30)], "doc_id bigint, text string")
    assert {r.template for r in mine_templates(messages(df)).collect()} == {"Código <*> del caso abierto por <*>"} or len({r.template for r in mine_templates(messages(df)).collect()}) == 1
    assert find_residue(df.limit(0)).collect() == []


def test_rare_messages_of_a_common_leaf_and_failures_told_by_us(spark):
    words = [chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)]
    ordinary = [f"The team said hello there {w}" for w in words]
    bad = ["The team said placeholder text now", "We could not load this page, try again later", "Our server is temporarily unavailable"]
    fine = ["We design friendly pages that say try again later", "Our error pages for lost visitors say page not found"]
    docs = spark.createDataFrame(list(enumerate(ordinary + bad + fine)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in find_residue(docs).collect()) == [100, 101, 102]


#: Wording of other sites, in neither the rules nor the labelled table.
UNSEEN_BAD = [
    "404 Not Found", "Just a moment...", "The requested URL was not found on this server", "Error establishing a database connection", "Please enable cookies to continue",
    "This page could not be found", "An internal error occurred, try again in a moment", "Please turn on JavaScript to use this site", "Verify that you are a person to continue",
    "La página pedida no existe", "Tu sesión expiró, volvé a iniciar", "Activá JavaScript en tu navegador", "Ocorreu um erro ao carregar a página", "Insert your summary here",
]
UNSEEN_GOOD = [
    "page not found rates fell by a third after the redesign", "internal server error rates fell in march", "The session on accessibility lasts an hour", "Our browser extension has a million users",
    "Buscamos quien escriba pruebas y cuide los errores del portal", "La sesión de fotos es el martes", "A equipe reduziu os erros do site", "We train people who never wrote JavaScript",
]


def test_messages_never_seen(spark):
    docs = spark.createDataFrame(list(enumerate(UNSEEN_BAD + UNSEEN_GOOD)), "doc_id bigint, text string")
    got = {r.doc_id for r in find_residue(docs).collect()}
    bad = set(range(len(UNSEEN_BAD)))
    assert len(got & bad) >= 0.9 * len(bad) and not got - bad


def test_a_verdict_reaches_every_message_of_its_template(spark):
    """Alone, these names outweigh the words of the failure; as one template they don't."""
    names = [chr(97 + i) + "rel" + chr(97 + j) for i in range(8) for j in range(8)]
    texts = [f"No pudimos cargar la vista del equipo {n}" for n in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len({r.template for r in mine_templates(messages(docs)).collect()}) == 1
    assert {r.doc_id for r in find_residue(docs).collect()} == set(range(len(texts)))
