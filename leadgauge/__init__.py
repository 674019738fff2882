"""Lead scoring of free-plan accounts, written as Spark DataFrame plans."""

from leadgauge.config import Rule, ScorecardConfig
from leadgauge.plans.scorecard import counted_scorecard, scorecard_events, weighted_scorecard
from leadgauge.plans.sheets import sheet, sheet_of, write_sheet_csv, write_sheets

__all__ = [
    "Rule",
    "ScorecardConfig",
    "counted_scorecard",
    "scorecard_events",
    "sheet",
    "sheet_of",
    "weighted_scorecard",
    "write_sheet_csv",
    "write_sheets",
]
