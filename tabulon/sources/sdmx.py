"""SDMX 3 structure messages: data structures, mappings of aliases to dataflows, and transformation schemes."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import SparkSession

from ..errors import InvalidArgument, UndefinedVariable
from ..model import ATTRIBUTE, IDENTIFIER, MEASURE, Component, Dataset, Structure
from .files import schema_of

#: SDMX text types and the script types that carry them.
TEXT_TYPES = {
    "string": ("String", "Alpha", "AlphaNumeric", "URI", "XHTML", "IdentifiableReference", "GeospatialInformation"),
    "integer": ("BigInteger", "Integer", "Long", "Short", "Count", "InclusiveValueRange"),
    "number": ("Numeric", "Decimal", "Float", "Double", "ExclusiveValueRange", "Incremental"),
    "boolean": ("Boolean",),
    "date": ("ObservationalTimePeriod", "StandardTimePeriod", "BasicTimePeriod", "GregorianTimePeriod", "GregorianYear", "GregorianYearMonth", "GregorianDay", "DateTime", "ReportingTimePeriod", "TimeRange", "Month", "MonthDay", "Day", "Time"),
}
KINDS = {name: kind for kind, names in TEXT_TYPES.items() for name in names}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def every(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if local(e.tag) == name]


def child_text(e: ET.Element, name: str) -> str | None:
    found = next((c for c in e.iter() if local(c.tag) == name and c is not e), None)
    return (found.text or "").strip() if found is not None else None


def last_part(urn: str | None) -> str | None:
    """The id at the end of a reference: after the colon, before the version."""
    return urn.rpartition(":")[2].partition("(")[0] if urn else None


def component_of(e: ET.Element, role: str) -> Component:
    name = e.get("id") or last_part(child_text(e, "ConceptIdentity")) or ""
    formats = [x for x in e.iter() if local(x.tag) in ("TextFormat", "EnumerationFormat")]
    kind = KINDS.get(formats[0].get("textType", "String"), "string") if formats else "string"
    return Component(name, kind, role, domain=last_part(child_text(e, "Enumeration")))


def structure_of(dsd: ET.Element) -> Structure:
    parts = []
    for tag, role in (("Dimension", IDENTIFIER), ("TimeDimension", IDENTIFIER), ("Measure", MEASURE), ("PrimaryMeasure", MEASURE), ("Attribute", ATTRIBUTE)):
        parts += [component_of(e, role) for e in every(dsd, tag)]
    return Structure(parts)


def parsed(text: str) -> ET.Element:
    return ET.fromstring(text)


def read_structure(text: str, dsd_id: str) -> Structure:
    for dsd in every(parsed(text), "DataStructure"):
        if dsd.get("id") == dsd_id:
            return structure_of(dsd)
    raise UndefinedVariable(dsd_id)


def structure_of_dataflow(text: str, dataflow_id: str) -> Structure:
    root = parsed(text)
    for flow in every(root, "Dataflow"):
        if flow.get("id") == dataflow_id:
            return read_structure(text, last_part(child_text(flow, "Structure")) or "")
    raise UndefinedVariable(dataflow_id)


def mappings(text: str) -> dict[str, Structure]:
    """Alias to structure, by the message's VTL mappings."""
    out = {}
    for m in every(parsed(text), "VtlMapping"):
        alias = m.get("alias") or m.get("id")
        target = last_part(child_text(m, "Dataflow") or child_text(m, "DataflowAlias") or child_text(m, "GenericDataflow"))
        if alias and target:
            out[alias] = structure_of_dataflow(text, target)
    return out


def read_transformations(text: str) -> tuple[list[str], list[str]]:
    """(ruleset definitions, assignments) in message order."""
    root = parsed(text)
    rulesets = [child_text(e, "RulesetDefinition") or "" for e in every(root, "Ruleset")]
    steps = []
    for e in every(root, "Transformation"):
        op = "<-" if (e.get("isPersistent") or "").lower() == "true" else ":="
        result, body = child_text(e, "Result"), child_text(e, "Expression")
        if not result or not body:
            raise InvalidArgument("a transformation needs a result and an expression")
        steps.append(f"{result} {op} {body}")
    return rulesets, steps


class Workflow:
    """Runs a message's transformation scheme over bound datasets."""

    def __init__(self, spark: SparkSession, text: str, inputs: dict[str, Dataset] | None = None):
        self.spark, self.text, self.inputs = spark, text, dict(inputs or {})

    def script(self) -> str:
        rulesets, steps = read_transformations(self.text)
        return "".join(f"{s.rstrip().rstrip(';')};\n" for s in [*rulesets, *steps])

    def empty_inputs(self) -> dict[str, Dataset]:
        return {a: Dataset(self.spark.createDataFrame([], schema_of(s)), s) for a, s in mappings(self.text).items()}

    def run(self) -> dict[str, Dataset]:
        """The persistent results."""
        from ..session import Session

        session = Session(self.spark)
        for name, ds in self.inputs.items():
            session.bind(name, ds)
        return {k: v for k, v in session.run(self.script()).items() if isinstance(v, Dataset) and v.persistent}

    def preview(self) -> dict[str, Structure]:
        """Structures of all results, from empty inputs."""
        from ..session import Session

        session = Session(self.spark)
        for name, ds in {**self.empty_inputs(), **self.inputs}.items():
            session.bind(name, ds)
        return {k: v.structure for k, v in session.run(self.script()).items() if isinstance(v, Dataset)}
