"""A transaction ledger on Spark: statements in, one canonical table, filters, rules and totals over it."""

import sys

from pyspark import cloudpickle

from ledgerloom.functions.predicates import Matches, PerValue, Text
from ledgerloom.operators.filtering import filter_frame, filter_ledger
from ledgerloom.operators.rules import Action, Condition, Rule, category_rule
from ledgerloom.plans.ledger import Ledger
from ledgerloom.sources.layouts import CHASE, LLOYDS_CC, MONZO, Layout, find_layout, register

__all__ = [
    "CHASE",
    "LLOYDS_CC",
    "MONZO",
    "Action",
    "Condition",
    "Layout",
    "Ledger",
    "Matches",
    "PerValue",
    "Rule",
    "Text",
    "category_rule",
    "filter_frame",
    "filter_ledger",
    "find_layout",
    "register",
]

# The few Python functions that run in tasks travel with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
