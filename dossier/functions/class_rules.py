"""Offline labelling by feature words, so that every job runs without a service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.answers import NOT_CLASSIFIABLE
from dossier.functions.text import contains_any, fold

# The six functional classes in list order.
CLASSES = (
    "Lineareinheit",
    "Gantry",
    "Greifer",
    "Handhabungsbaugruppe / kombinierte Einheit",
    "Roboter",
    "Rotationseinheit",
)

# Lower-case feature words of each class.
FEATURES = {
    "Lineareinheit": (
        "lineareinheit", "linearführung", "schlitten", "hubachse", "pneumatikzylinder",
        "spindel", "zahnriemen", "linearer aktor", "linearachse",
    ),
    "Gantry": ("gantry", "portal", "achssystem", "kartesisch", "orthogonal"),
    "Greifer": (
        "greifer", "greifbacke", "greiffinger", "klemm", "sauger", "vakuum", "endeffektor",
    ),
    "Handhabungsbaugruppe / kombinierte Einheit": (
        "handhabung", "handling", "übergabe", "kombinierte einheit",
    ),
    "Roboter": ("roboter", "industrieroboter", "roboterarm", "roboterflansch"),
    "Rotationseinheit": (
        "rotationseinheit", "dreheinheit", "schwenk", "rundtisch", "drehteller",
        "rotationsachse", "wendeeinheit", "winkelverstellung",
    ),
}


def feature_label(text: Column) -> Column:
    """The only class whose features occur; with features of several classes the combined
    class; with none the fallback."""
    folded = fold(text)
    hits = F.array_compact(
        F.array(*[F.when(contains_any(folded, words), F.lit(label))
                  for label, words in FEATURES.items()])
    )
    combined = CLASSES[3]
    return (
        F.when(F.size(hits) == 1, hits[0])
        .when(F.size(hits) > 1, combined)
        .otherwise(NOT_CLASSIFIABLE)
    )
