"""Field specifications: the dictionaries, query expansion, and the brief read by rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .text import contains_any


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    synonyms: tuple[str, ...] = ()
    unit: str = ""

    @property
    def screening_terms(self) -> list[str]:
        return [self.label, self.name, *self.synonyms]


@dataclass(frozen=True)
class Spec:
    targets: tuple[Field, ...] = ()
    required: tuple[Field, ...] = ()
    optional: tuple[Field, ...] = ()
    sources: tuple[str, ...] = ("text", "table", "figure")
    exclusions: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    brief: str = ""
    version: str = field(default="1.1")

    def terms_for(self, name: str) -> list[str]:
        """Label and synonyms of a field of the specification, else hints, else the name with spaces; each once."""
        for f in (*self.targets, *self.required, *self.optional):
            if f.name == name:
                return list(dict.fromkeys([f.label, *f.synonyms]))
        return list(K.FIELD_HINTS.get(name, (name.replace("_", " "),)))

    def query_for(self, name: str) -> str:
        return " ".join(dict.fromkeys(self.terms_for(name)))


def looked_up(names: DataFrame, spec: Spec, name: str = "field_name") -> DataFrame:
    """names with role (target, context, hint or name), terms and query of each field: the first role that knows it counts."""
    roles = (("target", {f.name: spec.terms_for(f.name) for f in spec.targets}), ("context", {f.name: spec.terms_for(f.name) for f in (*spec.required, *spec.optional)}), ("hint", {k: list(v) for k, v in K.FIELD_HINTS.items()}))
    key = F.col(name)
    role, terms = F.lit("name"), F.array(F.replace(key, F.lit("_"), F.lit(" ")))
    for label, known in reversed(roles):
        for field_name, said in known.items():
            role = F.when(key == field_name, label).otherwise(role)
            terms = F.when(key == field_name, F.array(*[F.lit(t) for t in said])).otherwise(terms)
    return names.withColumns({"role": role, "terms": terms}).withColumn("query", F.array_join(F.array_distinct("terms"), " "))


def expected_sections(name: str) -> tuple[str, ...]:
    return K.EXPECTED_SECTIONS.get(name, K.EXPECTED_DEFAULT)


# ---------------------------------------------------------------- briefs, many at a time

TARGETS = tuple(Field(n, label, s, u) for n, label, s, u in K.TARGET_FIELDS)
CONTEXTS = tuple(Field(n, label, s) for n, label, s in K.CONTEXT_FIELDS)


def brief_text(c) -> Column:
    """White space collapsed; case stays."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    parts = F.split(c, r"(?<=[。！？!?；;])|\n+")
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def _named(names, hits) -> Column:
    return F.filter(F.array(*[F.when(h, F.lit(n)) for n, h in zip(names, hits, strict=True)]), lambda x: x.isNotNull())


def _mentions(f: Field, markers: tuple[str, ...] = ()):
    """Predicate on a sentence: names the field and, if given, holds a marker."""
    if not markers:
        return lambda s: contains_any(s, list(f.synonyms))
    return lambda s: contains_any(s, list(f.synonyms)) & contains_any(s, list(markers))


def interpreted(briefs: DataFrame, brief: str = "brief") -> DataFrame:
    """briefs with targets, required, optional, sources, exclusions (names in dictionary order), custom_target and warnings."""
    text = brief_text(brief)
    has = lambda terms: contains_any(text, list(terms))
    targets = _named([f.name for f in TARGETS], [has(f.synonyms) for f in TARGETS])
    parts = sentences(text)
    mentioned = [F.exists(parts, _mentions(f)) for f in CONTEXTS]
    must = [F.exists(parts, _mentions(f, K.REQUIRED_MARKERS)) for f in CONTEXTS]
    names = [f.name for f in CONTEXTS]
    sources = _named(list(K.SOURCE_TERMS), [has(t) for t in K.SOURCE_TERMS.values()])
    out = briefs.withColumns(
        {
            "_t": targets,
            "required": _named(names, must),
            "optional": _named(names, [m & ~r for m, r in zip(mentioned, must, strict=True)]),
            "sources": F.when(F.size(sources) > 0, sources).otherwise(F.array(*[F.lit(x) for x in K.SOURCE_TERMS])),
            "exclusions": _named(list(K.EXCLUSION_TERMS), [has(t) for t in K.EXCLUSION_TERMS.values()]),
            "custom_target": custom_target(text),
        }
    )
    none = F.size("_t") == 0
    warnings = F.filter(F.array(F.when(none, F.lit(K.WARN_TARGET)), F.when(F.size("required") == 0, F.lit(K.WARN_REQUIRED))), lambda x: x.isNotNull())
    return out.withColumns({"targets": F.when(none, F.array(F.lit("custom_target"))).otherwise(F.col("_t")), "custom_target": F.when(none, F.col("custom_target")), "warnings": warnings}).drop("_t")


def custom_target(text: Column) -> Column:
    """The phrase after a verb of wanting, else the first 30 characters, else a fixed word."""
    said = F.trim(F.regexp_extract(text, "(?iu)" + K.CUSTOM_TARGET_PATTERN, 1))
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(F.trim(F.substring(text, 1, 30)), F.lit("")), F.lit(K.CUSTOM_FALLBACK))


def interpret(spark, brief: str) -> Spec:
    """One brief as a Spec."""
    if not 12 <= len(brief) <= 8000:
        raise ValueError("a brief has 12 to 8000 characters")
    r = interpreted(spark.createDataFrame([(brief,)], "brief string")).withColumn("brief", brief_text("brief")).first()
    by_name = {f.name: f for f in (*TARGETS, *CONTEXTS)}
    targets = [by_name[n] for n in r.targets] if r.targets != ["custom_target"] else [Field("custom_target", K.CUSTOM_LABEL, (r.custom_target,))]
    pick = lambda names: tuple(by_name[n] for n in names)
    return Spec(tuple(targets), pick(r.required), pick(r.optional), tuple(r.sources), tuple(r.exclusions), tuple(r.warnings), r.brief)


__all__ = ["CONTEXTS", "TARGETS", "Field", "Spec", "brief_text", "custom_target", "expected_sections", "interpret", "interpreted", "looked_up", "sentences"]
