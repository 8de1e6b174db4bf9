"""Skill scores of yes/no forecasts, as columns over counts of hits, misses and false alarms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _ratio(a: Column, b: Column, otherwise: float = NAN) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / F.nullif(b, F.lit(0.0)))


def score(name: str, tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """A score by name or short name; NaN where it isn't defined, as it always is without an observed event."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    n, events, forecasts, none = tp + tn + fp + fn, tp + fn, tp + fp, fp + tn
    hit, false = _ratio(tp, events), _ratio(fp, none)
    chance, chance_none = _ratio(forecasts * events, n), _ratio(none * (fn + tn), n)
    odds = F.when(fp * fn == 0, F.lit(float("inf"))).otherwise(tp * tn / F.nullif(fp * fn, F.lit(0.0)))
    lf, lh, l1f, l1h = F.ln(false), F.ln(hit), F.ln(1 - false), F.ln(1 - hit)
    edi = F.when((hit == 1) & (false == 0), 1.0).when(hit == 0, 0.0).when(false == 0, F.lit(NAN)).otherwise((lf - lh) / (lf + lh))
    sedi = (
        F.when(none == 0, F.lit(NAN)).when((hit == 1) & (false == 0), 1.0).when(hit == 0, 0.0)
        .when((hit == 1) | (false == 0) | (false == 1), F.lit(NAN)).otherwise((lf - lh + l1h - l1f) / (lf + lh + l1h + l1f))
    )
    formulas = {
        "base_rate": events / n,
        "forecast_rate": forecasts / n,
        "bias": _ratio(forecasts, events),
        "hit_rate": hit,
        "false_alarm_rate": false,
        "false_alarm_ratio": _ratio(fp, forecasts, 0.0),
        "proportion_correct": (tp + tn) / n,
        "success_index": (hit + _ratio(tn, none)) / 2,
        "critical_success_index": _ratio(tp, tp + fp + fn),
        "gilbert": _ratio(tp - chance, tp + fp + fn - chance),
        "heidke": _ratio(tp + tn - chance - chance_none, n - chance - chance_none),
        "peirce": hit - false,
        "clayton": _ratio(tp, forecasts) - _ratio(fn, fn + tn),
        "doolittle": _ratio(tp * tn - fp * fn, F.sqrt(forecasts * (fn + tn) * events * none)),
        "odds_ratio": odds,
        "log_odds_ratio": F.when(odds == 0, F.lit(float("-inf"))).otherwise(F.ln(odds)),
        "odds_ratio_skill": F.when(odds == float("inf"), 0.0).otherwise((odds - 1) / (odds + 1)),
        "eds": F.when(tp == 0, F.lit(-1.0)).when(tp == n, F.lit(NAN)).otherwise(2 * F.ln(events / n) / F.nullif(F.ln(tp / n), F.lit(0.0)) - 1),
        "seds": F.when(tp == 0, 0.0).when(tp == n, F.lit(NAN)).otherwise(F.ln(chance / tp) / F.nullif(F.ln(tp / n), F.lit(0.0))),
        "edi": edi,
        "sedi": sedi,
        "precision": _ratio(tp, forecasts),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return F.when(events == 0, F.lit(NAN)).otherwise(formulas[ALIASES.get(name.lower(), name.lower())])


#: Other names of scores.
ALIASES = {
    "brate": "base_rate", "frate": "forecast_rate", "h": "hit_rate", "recall": "hit_rate", "f": "false_alarm_rate", "far": "false_alarm_ratio", "pc": "proportion_correct",
    "accuracy": "proportion_correct", "si": "success_index", "csi": "critical_success_index", "gss": "gilbert", "hss": "heidke", "pss": "peirce", "css": "clayton", "dss": "doolittle",
    "or": "odds_ratio", "lor": "log_odds_ratio", "orss": "odds_ratio_skill",
}

#: The scores, in their usual order.
NAMES = [
    "base_rate", "forecast_rate", "bias", "hit_rate", "false_alarm_rate", "false_alarm_ratio", "proportion_correct", "success_index", "critical_success_index", "gilbert", "heidke",
    "peirce", "clayton", "doolittle", "odds_ratio", "log_odds_ratio", "odds_ratio_skill", "eds", "seds", "edi", "sedi", "precision", "f1",
]
CLASSIC = {"SEDI": "sedi", "F": "false_alarm_rate", "FAR": "false_alarm_ratio", "H": "hit_rate", "CSI": "critical_success_index", "Bias": "bias", "Accuracy": "proportion_correct", "Precision": "precision", "Recall": "hit_rate", "F1": "f1"}
