"""Semantic heuristics by kind of question, as rules that are data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import EXTRACTIVE, KIND_NAMES

# Keywords, patterns and hints that results depend on.
KIND_KEYWORDS = [
    ("hora", ["hora"]),
    ("fecha", ["fecha", "día"]),
    ("valor", ["valor", "cuanto", "cuánto"]),
    ("lugar", ["lugar", "dónde", "donde", "dirección", "direccion", "calles"]),
    ("objetos", ["objeto", "robado", "robaron", "sustraid", "sustraíd"]),
]
OLD_KIND_KEYWORDS = [(kind, ["lugar", "dónde", "donde"] if kind == "lugar" else words) for kind, words in KIND_KEYWORDS]
TIME_OLD = r"\b\d{1,2}h\d{2}\b|\b\d{1,2}:\d{2}\b|\b\d{1,2}\s*(am|pm|de la mañana|de la tarde|de la noche)\b"
DATE_OLD = r"\b\d{1,2}\s+de\s+\w+\s+de\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
MONEY_OLD = r"\$\s?\d|\b\d{3,}\b|d[óo]lares|centavos"
PLACES_OLD = ["calle", "av", "avenida", "sector", "barrio", "vía", "via", "parroquia", "esquina", "diagonal", "altura"]
OBJECTS_OLD = ["teléfono", "celular", "marca", "equipo", "dinero", "mochila", "cartera", "bicicleta", "computador", "laptop", "reloj", "cadena"]
GENERIC_TIMES = ["aproximadamente", "hora", "dia", "día"]
TIME = (
    r"\b\d{1,2}\s*h\s*\d{2}\b|\b\d{1,2}:\d{2}\b|\b\d{1,2}\s+\d{2}\b|\b\d{1,2}\s*(am|pm)\b|"
    r"\b(mañana|manana|tarde|noche|madrugada|mediodía|mediodia|hora|horas)\b"
)
DATE = (
    r"\b\d{1,2}\s+de\s+[a-zñ]+\s+(del|de)\s+\d{2,4}\b|\b\d{1,2}\s+de\s+[a-zñ]+\b|"
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}-\d{1,2}-\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|"
    r"\b(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)\b"
)
MONEY = r"\$\s?\d|\b\d[\d.,]*\b|d[óo]lares|dolares|centavos|usd"
DISTANCE = r"\b(metros|metro|kilómetros|kilometros|km|cuadras|cuadra)\b"
PLACES = [
    "calle", "calles", "av", "avenida", "sector", "barrio", "vía", "via", "parroquia", "esquina", "diagonal", "altura",
    "intersección", "interseccion", "cdla", "ciudadela", "urbanización", "urbanizacion", "coop", "cooperativa", "mz", "villa",
    "domicilio", "taller", "iglesia", "parqueadero", "parque", "banco", "fábrica", "fabrica", "escuela", "colegio", "hospital",
    "terminal", "aeropuerto", "puente", "redondel", "rotonda", "km", "entre", "casa", "residencia", "local", "oficina", "bodega",
    "farmacia", "tienda", "mercado", "hotel",
]
OBJECTS = [
    "teléfono", "telefono", "celular", "marca", "equipo", "dinero", "mochila", "cartera", "bicicleta", "computador",
    "computadora", "laptop", "reloj", "cadena", "moto", "vehículo", "vehiculo", "auto", "carro", "tablet", "tableta", "televisor",
    "tv", "joyas", "aretes", "anillo", "zapatos", "ropa", "documentos", "llaves", "radio", "batería", "bateria", "extintor",
    "mercaderia", "mercadería", "viveres", "víveres", "compresor", "plancha", "dvd", "microondas", "refrigeradora", "cocina",
    "herramientas", "maleta", "billetera", "pertenencias", "led", "candados",
]
VAGUE_PLACES = [
    "centro", "ciudad", "domicilio", "taller", "lugar indicado", "en cuadra", "a mi domicilio",
    "a mi taller", "carrera", "misa de la iglesia", "en el lugar indicado",
]
VAGUE_OBJECTS = ["varios objetos", "el equipo completo", "mensaje de texto", "cosas", "objetos varios"]
TIME_CONTEXT = [
    "estacionado", "dejé", "deje", "al retornar", "me percaté", "me percate", "observó", "observe", "al salir", "cuando regresé",
    "cuando regrese", "hasta acudir", "hasta realizar", "al regresar", "al volver", "cuando salí", "cuando sali",
]
# End of the fixed values.

Rule = Callable[[Column, Column], Column]
"""From the normalised answer and context, the points that count against the answer."""


def points(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def matches(c: Column, pattern: str) -> Column:
    """A search that knows all letters and both cases."""
    return F.rlike(c, F.lit("(?iuU)" + pattern))


def wanted(pattern: str) -> Rule:
    return lambda answer, _: points(~matches(answer, pattern))


def forbidden(pattern: str) -> Rule:
    return lambda answer, _: points(matches(answer, pattern))


def vague(phrases: Sequence[str]) -> Rule:
    return lambda answer, _: points(T.any_hint(answer, phrases))


def one_of(words: Sequence[str]) -> Rule:
    return lambda answer, _: points(answer.isin(*words))


def short_without(hints: Sequence[str], words: int) -> Rule:
    return lambda answer, _: points(~T.any_hint(answer, hints) & (T.word_count(answer) <= words))


def marked_near(pattern: str, markers: Sequence[str], margin: int = 120) -> Rule:
    """The pattern is there, but a marker stands around the answer's first place in the context."""

    def rule(answer: Column, context: Column) -> Column:
        at = F.when(answer == "", F.lit(0)).otherwise(F.instr(context, answer) - 1)
        around = T.window_around(context, at, F.length(answer), margin)
        return points(matches(answer, pattern) & (at >= 0) & T.any_hint(around, markers))

    return rule


def surplus(hints: Sequence[str], more: int = 1) -> Rule:
    """The context has over ``more`` hits beyond the answer's."""
    return lambda answer, context: points(T.count_hits(context, hints) > T.count_hits(answer, hints) + more)


@dataclass(frozen=True)
class SemanticRules:
    """Rules by kind of question; ``any_point`` makes the score 0 or 1."""

    rules: dict[str, list[Rule]]
    any_point: tuple[str, ...] = ()
    statuses: tuple[str, ...] = field(default=EXTRACTIVE)

    def score(self, kind: Column, answer: Column, context: Column, status: Column) -> Column:
        out = F.lit(0)
        for name, rules in self.rules.items():
            total = sum((rule(answer, context) for rule in rules[1:]), rules[0](answer, context))
            out = F.when(kind == name, F.least(total, F.lit(1)) if name in self.any_point else total).otherwise(out)
        return F.when(status.isin(*self.statuses), out).otherwise(0)


OLD_RULES = SemanticRules(
    {
        "hora": [wanted(TIME_OLD), one_of(GENERIC_TIMES)],
        "fecha": [wanted(DATE_OLD)],
        "valor": [wanted(MONEY_OLD)],
        "lugar": [short_without(PLACES_OLD, 1)],
        "objetos": [short_without(OBJECTS_OLD, 1)],
    },
    any_point=("hora",),
)
RULES = SemanticRules(
    {
        "hora": [wanted(TIME), marked_near(TIME, TIME_CONTEXT)],
        "fecha": [wanted(DATE)],
        "valor": [wanted(MONEY)],
        "lugar": [forbidden(DISTANCE), vague(VAGUE_PLACES), short_without(PLACES, 2)],
        "objetos": [vague(VAGUE_OBJECTS), short_without(OBJECTS, 2), surplus(OBJECTS)],
    }
)


def kind_of(normal: Column, old: bool = False) -> Column:
    """The first kind with a keyword in the normal form of a question, else ``otro``."""
    out = F.lit("otro")
    for kind, words in reversed(OLD_KIND_KEYWORDS if old else KIND_KEYWORDS):
        out = F.when(T.any_hint(normal, words), kind).otherwise(out)
    return out


def question_kind(question: Column | str, old: bool = False) -> Column:
    """The kind of a question, by its exact normal form."""
    return T.let(lambda x: kind_of(x["normal"], old), normal=T.normalize(question))


def english(kind: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, T.column(kind)), F.lit("other"))


def heuristics(frame: DataFrame, old_kind: bool = False, exact: bool = True, rules: SemanticRules = RULES, old_rules: SemanticRules = OLD_RULES, normal_context: Column | str | None = None) -> DataFrame:
    """Adds ``question_kind``, ``semantic_flag_v1``, ``semantic_score``, ``semantic_flag_v2`` and the active ``semantic_heuristic_flag``.

    ``normal_context`` is the context's normal form, where the caller has worked it out once for the many rows of a context; else it is
    worked out for each row that has a status of the rules.
    """
    def both(x: Column) -> Column:
        args = (x["kind"], x["answer"], x["context"], x["status"])
        return F.struct((old_rules.score(*args) >= 1).alias("old"), rules.score(*args).alias("score"))

    kind = T.let(lambda x: kind_of(x["normal"], old_kind), normal=T.normalize("question", exact))
    frame = frame.withColumn("question_kind", kind)
    scored = F.col("qc_status").isin(*rules.statuses, *old_rules.statuses)
    context = T.normalize("context", exact) if normal_context is None else T.column(normal_context)
    found = T.let(both, kind=F.col("question_kind"), answer=F.when(scored, T.normalize("answer_text", exact)), context=F.when(scored, context), status=F.col("qc_status"))
    flag = F.col("_found.score") >= 1
    return frame.withColumn("_found", found).withColumns(
        {"semantic_flag_v1": F.col("_found.old"), "semantic_score": F.col("_found.score"), "semantic_flag_v2": flag, "semantic_heuristic_flag": flag}
    ).drop("_found")


def audit_flag(frame: DataFrame, rules: SemanticRules = RULES) -> DataFrame:
    """The flag as the audit computes it: accents stay in texts, and the kind is a column of the rows."""
    score = T.let(
        lambda x: rules.score(x["kind"], x["answer"], x["context"], x["status"]),
        kind=F.lower(T.or_empty("question_kind")), answer=T.collapse("answer_text"), context=T.collapse("context"), status=F.col("qc_status"),
    )
    return frame.withColumn("audit_flag", score >= 1)
