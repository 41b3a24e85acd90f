"""Column-name contract shared by the operators.

Every operator takes its key and value columns as parameters; these are the
defaults. The prefixes are part of the contract because leakage rules are
written against the prefixed names.
"""

GROUP = "group_id"
ITEM = "item_id"
SOURCE = "source"
SCORE = "score"
COUNT = "evidence_count"
LABEL = "label"

# Column prefixes of the feature-table contract.
SOURCE_PREFIX = "assoc_ds__"
DIMENSION_PREFIX = "dim__"
MISSING_PREFIX = "missing__"
FLAG_PREFIX = "prio__"
PATHWAY_PREFIX = "path__"
NETWORK_PREFIX = "net__"
EXPRESSION_PREFIX = "expr__"
DIVERSITY_PREFIX = "diversity__"
CONTRIBUTION_PREFIX = "contrib__"
LABEL_PREFIX = "label__"
OVERALL_PREFIX = "assoc_overall__"

WEIGHTED_SCORE = "prioritization_score"
COMPLETENESS = "evidence_completeness"
DISPLAY_COMPLETENESS = "app_evidence_completeness"


def dim(name: str) -> str:
    return DIMENSION_PREFIX + name


def missing(name: str) -> str:
    return MISSING_PREFIX + name


def contrib(name: str) -> str:
    return CONTRIBUTION_PREFIX + name


def source_score(source: str) -> str:
    return f"{SOURCE_PREFIX}{source}_score"


def source_count(source: str) -> str:
    return f"{SOURCE_PREFIX}{source}_evidence_count"
