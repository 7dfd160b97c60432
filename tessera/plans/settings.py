"""What the registered queries ask of the derived graph."""

from __future__ import annotations

from tessera.sources.readers import PredicateCut, QuestionType, RelevanceCut

PREFIX = "kg:"
ANCHOR = "SUPP"
PATTERNS = ("#00000000", "7", "no such name")
SEED = "13"
PER_TYPE = 60
MARGIN = 0.05
CANDIDATES, TOP_K = 25, 20
START = "NATION:3"
PREDICATE_CUTS = (PredicateCut("none (baseline)"), PredicateCut("drop located_in", ("kg:located_in",)), PredicateCut("drop located_in + contains", ("kg:located_in", "kg:contains")))
RELEVANCE_CUTS = (
    RelevanceCut("whole graph"), RelevanceCut("drop non-human", True), RelevanceCut("+ drop contains and part_of", True, ("kg:contains", "kg:part_of")),
    RelevanceCut("+ drop nations", True, ("kg:contains", "kg:part_of"), ("kg:Nation",)),
)
SUPPLIER_TYPES = (
    QuestionType("supplied", "What does {disease} supply?", "out", ("kg:supplies",), "PART", 5),
    QuestionType("seat", "Where is {disease}?", "out", ("kg:located_in",), "NATION", 1),
)
CUSTOMER_TYPES = (QuestionType("ordered", "What did {disease} order?", "in", ("kg:placed_by",), "ORD", 3),)
#: Predicate of each description, by the label whose centroid describes it.
DESCRIBED = ("kg:supplies", "kg:contains", "kg:placed_by", "kg:located_in", "kg:part_of")
#: True predicates of questions by the parity of their vector's label.
TRUTH = (("even", "kg:supplies"), ("even", "kg:placed_by"), ("odd", "kg:contains"))
