"""Prompts, answers and run statuses.

``labels`` is the ordered list of allowed labels. It is part of every prompt, so it is
small by nature and passed as a Python sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import fold, strip

# Fixed values.
NOT_CLASSIFIABLE = "Nicht klassifizierbar"
UNRECOGNISED = "UNRECOGNISED_RESPONSE"
ERROR_LABELS = ("UNRECOGNISED_RESPONSE", "ERROR", "API_ERROR")
NO_READABLE_FILES = "- Keine direkt lesbaren Dateien vorhanden"


def _folded(label: str) -> str:
    return label.casefold()


def _by_folded(answer: Column, labels: Sequence[str]) -> Column:
    """Label equal to the answer without case; the last of several spellings wins."""
    spellings = {_folded(label): label for label in labels}
    table = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return table[fold(answer)]


def clean_backticks(raw: Column) -> Column:
    return strip(F.btrim(strip(raw), F.lit("`")))


def clean_quotes(raw: Column) -> Column:
    """Without backticks, then double, then single quotes around the answer."""
    return strip(F.btrim(F.btrim(clean_backticks(raw), F.lit('"')), F.lit("'")))


def contained_labels(answer: Column, labels: Sequence[str]) -> Column:
    """Allowed labels that occur in the answer, in list order."""
    text = fold(answer)
    found = [F.when(text.contains(_folded(label)), F.lit(label)) for label in dict.fromkeys(labels)]
    return F.array_compact(F.array(*found))


def tolerant_label(raw: Column, labels: Sequence[str]) -> Column:
    """The label answered exactly, else the only allowed label the answer contains."""
    allowed = [*labels, NOT_CLASSIFIABLE]
    answer = clean_backticks(raw)
    inside = contained_labels(answer, allowed)
    return F.coalesce(_by_folded(answer, allowed), F.when(F.size(inside) == 1, inside[0]))


def strict_label(raw: Column, labels: Sequence[str], fallback_allowed: bool = False) -> Column:
    """The label answered exactly apart from case and quotes, else null."""
    allowed = [*labels, NOT_CLASSIFIABLE] if fallback_allowed else list(labels)
    return _by_folded(clean_quotes(raw), allowed)


def checked_label(raw: Column, labels: Sequence[str]) -> Column:
    """Exact spelling first, then without case; the fallback label is always allowed."""
    allowed = list(dict.fromkeys([*labels, NOT_CLASSIFIABLE]))
    answer = clean_quotes(raw)
    return F.coalesce(F.when(answer.isin(*allowed), answer), _by_folded(answer, allowed))


def rejection_reason(raw: Column, labels: Sequence[str]) -> Column:
    """Why :func:`tolerant_label` gave nothing; null when it gave a label."""
    inside = F.size(contained_labels(clean_backticks(raw), [*labels, NOT_CLASSIFIABLE]))
    return F.when(tolerant_label(raw, labels).isNull(),
                  F.when(inside > 1, "SEVERAL_LABELS").otherwise("NO_LABEL"))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("- "), item)), "\n")


def label_bullets(labels: Sequence[str]) -> str:
    return "\n".join(f"- {label}" for label in labels)


# Texts of the prompts. ``{...}`` marks what a run fills in.
SYSTEM_PROMPT = """Du bist ein technischer Experte für Baugruppen im Maschinen- und Anlagenbau.
Ordne jede Baugruppe genau einer vorgegebenen Funktionsklasse zu.
Nutze nur die bereitgestellte Benennung und – falls beigefügt – die technischen Dateien.
Gib ausschließlich den exakten Namen einer erlaubten Funktionsklasse aus.
Wenn die Informationen für eine belastbare Zuordnung nicht reichen, gib ausschließlich
'Nicht klassifizierbar' aus. Keine Begründung, kein Satzzeichen und kein zusätzlicher Text."""

ALL_FILES_TEXT = """Baugruppenbenennung: {name}

Beurteile die Baugruppenbenennung und alle beigefügten technischen Dateien.
Wähle genau eine der folgenden Funktionsklassen:
{labels}
- Nicht klassifizierbar
"""

NAME_ONLY_TEXT = """
Du bist ein technischer Experte für Baugruppenklassifikation im Maschinen- und Anlagenbau.

Klassifiziere den folgenden Baugruppennamen in genau eine der vorgegebenen Funktionsklassen.

Baugruppenname:
{name}

Zulässige Funktionsklassen:
{labels}

Regeln:
- Wähle genau eine Funktionsklasse aus der Liste.
- Antworte ausschließlich mit dem exakten Namen der Funktionsklasse, nie mit einer Abkürzung.
- Keine Erklärung, keine zusätzlichen Wörter.
- Wenn keine Klasse eindeutig passt, wähle "Nicht klassifizierbar".

Antwort:
"""

PRIORITISED_TEXT = """Du bist ein technischer Experte fuer Baugruppenklassifikation im Maschinen- und Anlagenbau.
Klassifiziere die folgende Baugruppe in genau eine der vorgegebenen Funktionsklassen.
Beruecksichtige dafuer sowohl den Baugruppennamen als auch alle beigefuegten Dateien.
Alle beigefuegten Dateien gehoeren zu derselben Baugruppe.
Der Baugruppenname ist ein besonders wichtiger Hinweis. Wenn der Name eindeutig
einer Funktionsklasse entspricht und die Dateien nicht klar widersprechen,
orientiere dich vorrangig am Baugruppennamen.

Baugruppenname:
{name}

Beigefuegte Dateien:
{files}

Zulaessige Funktionsklassen:
{labels}

Regeln:
- Orientiere die Klassifikation immer an der Hauptfunktion der Baugruppe.
- Waehle genau eine Funktionsklasse aus der Liste.
- Antworte ausschliesslich mit dem exakten Namen der Funktionsklasse, nie mit einer Abkuerzung.
- Keine Erklaerung, keine zusaetzlichen Woerter.
- Wenn keine Klasse eindeutig passt, waehle "Nicht klassifizierbar".

Antwort:"""

DESCRIBED_TEXT = """
Du bist ein technischer Experte fuer Baugruppenklassifikation im Maschinen- und Anlagenbau.

Klassifiziere die folgende Baugruppe in genau eine der vorgegebenen Funktionsklassen.
Nutze dafuer die Bezeichnungen und den Inhalt aller hochgeladenen Unterlagen.

SAP-Nummer:
{sap}

Teamcenter ID:
{tc}

Benennung (EN):
{name_en}

Benennung (DE):
{name_de}

Hochgeladene Unterlagen:
{files}

Zulaessige Funktionsklassen:
{labels}

Regeln:
- Waehle genau eine Funktionsklasse aus der Liste.
- Antworte ausschliesslich mit dem exakten Namen der Funktionsklasse.
- Keine Erklaerung, keine zusaetzlichen Woerter.
- Beurteile die Baugruppe insgesamt und nicht nur anhand eines einzelnen Dateinamens.
- Wenn keine Klasse eindeutig passt, antworte mit "Nicht klassifizierbar".

Antwort:
"""


def filled(text: str, labels: Sequence[str], **values: Column) -> Column:
    """A prompt text with its marks replaced by the label list and by columns."""
    pieces = []
    for literal, mark, _, _ in Formatter().parse(text):
        pieces.append(F.lit(literal))
        if mark is not None:
            pieces.append(F.lit(label_bullets(labels)) if mark == "labels" else values[mark])
    return F.concat(*pieces)


def question_all_files(name: Column, labels: Sequence[str]) -> Column:
    return filled(ALL_FILES_TEXT, labels, name=name)


def question_name_only(name: Column, labels: Sequence[str]) -> Column:
    return filled(NAME_ONLY_TEXT, labels, name=name)


def question_prioritised(name: Column, file_names: Column, labels: Sequence[str]) -> Column:
    return filled(PRIORITISED_TEXT, labels, name=name, files=bullets(file_names))


def prioritised_ends(name: Column, labels: Sequence[str]) -> tuple[Column, Column]:
    """The prompt before and after its list of files."""
    head, tail = PRIORITISED_TEXT.split("{files}")
    return filled(head, labels, name=name), filled(tail, labels)


def described_ends(
    sap: Column, tc: Column, name_en: Column, name_de: Column, labels: Sequence[str]
) -> tuple[Column, Column]:
    """The described prompt before and after its list of files."""
    head, tail = DESCRIBED_TEXT.split("{files}")
    values = {"sap": sap, "tc": tc, "name_en": name_en, "name_de": name_de}
    return filled(head, labels, **values), filled(tail, labels, **values)


def question_described(
    sap: Column, tc: Column, name_en: Column, name_de: Column, files: Column,
    labels: Sequence[str],
) -> Column:
    listed = F.when(F.size(files) > 0, bullets(files)).otherwise(NO_READABLE_FILES)
    return filled(DESCRIBED_TEXT, labels, sap=sap, tc=tc, name_en=name_en, name_de=name_de, files=listed)


# Fixed value: sentence added to the prompt when the first answer was not an allowed label.
REPEAT_HINT = (
    "\nDie vorherige Antwort war nicht exakt eine der erlaubten Klassen. "
    "Antworte jetzt nur mit einem exakten Klassennamen aus der Liste."
)

# Logged raw response: the parts of two service formats that carry text and usage.
RESPONSE_SCHEMA = (
    "candidates array<struct<content:struct<parts:array<struct<text:string>>>,"
    "finishReason:string>>, content array<struct<text:string>>, "
    "usageMetadata map<string,bigint>"
)


def parse_response(raw_json: Column) -> Column:
    return F.from_json(raw_json, RESPONSE_SCHEMA)


def response_text(parsed: Column) -> Column:
    """First text part of the first candidate, or a note naming the finish reason."""
    first = F.get(parsed["candidates"], F.lit(0))
    texts = F.filter(first["content"]["parts"], lambda part: part["text"].isNotNull())
    reason = F.concat(
        F.lit("(no text content, finishReason="),
        F.coalesce(first["finishReason"], F.lit("unknown")), F.lit(")"),
    )
    return F.coalesce(F.get(texts, F.lit(0))["text"], reason)


def response_text_joined(parsed: Column) -> Column:
    """All text parts of the first candidate in one string, blank for none."""
    parts = F.get(parsed["candidates"], F.lit(0))["content"]["parts"]
    return F.coalesce(F.array_join(F.transform(parts, lambda part: part["text"]), ""), F.lit(""))


def block_text(parsed: Column) -> Column:
    """Text of the first content block of the other format."""
    return F.coalesce(
        F.get(parsed["content"], F.lit(0))["text"], F.lit("(no text content)")
    )


def token_usage(parsed: Column) -> Column:
    return parsed["usageMetadata"]


def usage_json(usage: Column) -> Column:
    return F.to_json(F.coalesce(usage, F.create_map().cast("map<string,bigint>")))


def run_status(
    has_id: Column, name: Column, file_count: Column, match_status: Column,
    response: Column, error: Column, label: Column,
) -> Column:
    """Status of the all-files run, one per input row."""
    return (
        F.when(~has_id | (strip(F.coalesce(name, F.lit(""))) == ""),
               "SKIPPED: missing ID or Benennung")
        .when(F.coalesce(file_count, F.lit(0)) == 0,
              F.concat(F.lit("SKIPPED: no supported documents found ("), match_status, F.lit(")")))
        .when(error.isNotNull(), F.concat(F.lit("ERROR: "), error))
        .when(response.isNull(), F.lit(None).cast("string"))
        .when(label.isNull(), "CHECK: response is not one valid label")
        .otherwise("SUCCESS")
    )


def precheck_status(
    name: Column, folder: Column, match_method: Column, existing: Column, missing: Column
) -> Column:
    """Status of the priority-based run before any request is made."""
    return (
        F.when(name == "", "NO_BAUGRUPPENNAME")
        .when(folder.isNull(), match_method)
        .when((existing == 0) & (missing == 0), "NO_PRIORITY_1_2_FILES")
        .when(missing > 0, "FILE_NOT_FOUND")
        .otherwise("READY")
    )


# What a status of the priority-based run means, as its message.
STATUS_MESSAGES = {
    "NO_BAUGRUPPENNAME": "Benennung (EN) ist leer",
    "NO_PRIORITY_1_2_FILES": "Keine Zeile mit Priority 1 oder 2 gefunden",
    "FILE_NOT_FOUND": "Mindestens eine Priority-1/2-Datei fehlt; API-Aufruf wird nicht mit "
                      "unvollstaendigen Daten ausgefuehrt",
    "INVALID_LABEL": "Antwort stimmt nicht exakt mit einer erlaubten Funktionsklasse ueberein",
}


def status_message(status: Column, match_message: Column, error: Column) -> Column:
    """Error text of a row: the call's error, else the status' message, else the match's."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_MESSAGES.items() for x in pair])
    no_folder = F.when(~status.isin("READY", "OK", "API_ERROR"), match_message)
    return F.coalesce(error, table[status], F.nullif(no_folder, F.lit("")))


def answered_status(ready: Column, error: Column, response: Column, label: Column) -> Column:
    """Status of the priority-based run after the answers are in."""
    return (
        F.when(ready != "READY", ready)
        .when(error.isNotNull(), "API_ERROR")
        .when(response.isNull(), "READY")
        .when(label.isNull(), "INVALID_LABEL")
        .otherwise("OK")
    )
