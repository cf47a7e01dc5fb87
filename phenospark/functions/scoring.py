"""Column functions from probabilities to verdicts, confidences, evidence classes and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORK, FAIL, NO_CALL = "likely_to_work", "likely_to_fail", "no_call"


def verdict_by_band(p: Column, low: Column, high: Column) -> Column:
    return F.when(p <= low, WORK).when(p >= high, FAIL).otherwise(NO_CALL)


def prediction_set(p: Column, q_s: Column, q_r: Column) -> Column:
    """Bit 0: susceptible is plausible; bit 1: resistant is."""
    return (p <= q_s).cast("int") + 2 * ((1.0 - p) <= q_r).cast("int")


def verdict_by_set(p: Column, q_s: Column, q_r: Column, distance: Column, threshold: Column) -> Column:
    """The distance rule comes before the sets; only a set of one class is a call."""
    s = prediction_set(p, q_s, q_r)
    return F.when(distance > threshold, NO_CALL).when(s == 2, FAIL).when(s == 1, WORK).otherwise(NO_CALL)


def decision(p: Column, low: float, high: float, target_ok: Column) -> Column:
    """Struct ``prediction, reason``: gate, then band (closed), then 0.5."""
    off = lambda v, r: F.struct(F.lit(v).alias("prediction"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(~target_ok, off(NO_CALL, "missing_drug_target"))
        .when((p >= low) & (p <= high), off(NO_CALL, "uncertain_probability_band"))
        .when(p >= 0.5, off(FAIL, None))
        .otherwise(off(WORK, None))
    )


def confidence(prediction: Column, p: Column) -> Column:
    """Probability of the reported class, of a no-call the larger one."""
    return F.when(prediction == FAIL, p).when(prediction == WORK, 1.0 - p).otherwise(F.greatest(p, 1.0 - p))


def margin_confidence(verdict: Column, p: Column, low: Column, high: Column) -> Column:
    """How clearly p is past the edge of the band, 0.05 to 1; 0.3 without a call."""
    below = 0.5 + 0.5 * (low - p) / F.when(low > 1e-6, low).otherwise(1.0)
    above = 0.5 + 0.5 * (p - high) / F.when((1.0 - high) > 1e-6, 1.0 - high).otherwise(1.0)
    raw = F.when(verdict == WORK, below).when(verdict == FAIL, above).otherwise(0.3)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), raw))


def evidence_category(prediction: Column, p: Column, known: Column, supported: Column, cut: float = 0.35) -> Column:
    return (
        F.when(prediction == NO_CALL, "insufficient_or_conflicting_evidence")
        .when((prediction == FAIL) & known, "known_resistance_marker")
        .when((prediction == WORK) & (p < cut) & ~known, "no_known_resistance_signal")
        .when(supported, "statistical_association")
        .when(prediction == WORK, "no_known_resistance_signal")
        .otherwise("statistical_association")
    )


def evidence_class(confirmed: Column, any_hit: Column, verdict: Column) -> Column:
    return F.when(confirmed, "known_marker").when(any_hit | (verdict != WORK), "statistical_association").otherwise("no_known_signal")


def marker_label(symbol: Column, name: Column, cls: Column) -> Column:
    """symbol (name) [class], without what is missing or said twice; null if both names are."""
    s, n, c = (F.trim(F.coalesce(x, F.lit(""))) for x in (symbol, name, cls))
    both = F.when((s != "") & (n != "") & (F.lower(s) != F.lower(n)), F.concat(s, F.lit(" ("), n, F.lit(")"))).otherwise(F.when(s != "", s).otherwise(n))
    return F.when((s != "") | (n != ""), F.when(c != "", F.concat(both, F.lit(" ["), c, F.lit("]"))).otherwise(both))


def sentence(prediction: Column, p: Column, category: Column, markers: Column) -> Column:
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    genes = F.array_join(F.slice(markers, 1, 3), ", ")
    return (
        F.when(prediction == NO_CALL, F.concat(F.lit("No call. P(fail)="), F.format_string("%.3f", p), F.lit(".")))
        .when((prediction == FAIL) & (category == "known_resistance_marker"), F.concat(F.lit("Likely to fail: known resistance signal(s) ("), genes, F.lit("). P(fail)="), pct(p), F.lit(".")))
        .when(prediction == FAIL, F.concat(F.lit("Likely to fail. P(fail)="), pct(p), F.lit(".")))
        .otherwise(F.concat(F.lit("Likely to work. P(work)="), pct(1.0 - p), F.lit(".")))
    )


def gate_text(status: Column, missing: Column) -> Column:
    """Why a target gate passed or not, from its status and the loci that weren't seen."""
    loci = F.array_join(missing, ", ")
    return (
        F.when(status == "pass", "All target loci were seen in the assembly.")
        .when((status == "not_callable") & (F.size(missing) > 0), F.concat(F.lit("Not callable: no evidence for "), loci, F.lit(".")))
        .when(status == "not_callable", "Not callable: the assembly is not good enough.")
        .when(status == "absence_of_evidence", "No locus is defined for this drug; silence is no evidence.")
        .otherwise("The gate was not run.")
    )


def no_call_text(reason: Column, p: Column) -> Column:
    """Why no call was made; null for a call."""
    at = F.format_string(" (P(fail)=%.3f)", p)
    return (
        F.when(reason == "missing_drug_target", "No call: the drug's target was not found.")
        .when(reason == "uncertain_probability_band", F.concat(F.lit("No call: the probability lies in the uncertain band"), at, F.lit(".")))
        .when(reason == "conformal_band", F.concat(F.lit("No call: neither class or both are plausible"), at, F.lit(".")))
        .when(reason == "ani_ood", "No call: the genome is too far from all training genomes.")
        .when(reason == "conformal_band+ani_ood", F.concat(F.lit("No call: the genome is far from training genomes and neither class or both are plausible"), at, F.lit(".")))
    )


def node_label(text: Column, most: int = 24) -> Column:
    """A label of at most ``most`` characters; a longer one ends with an ellipsis."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def node_class(status: Column, verdict: Column) -> Column:
    """How a node of the tree is drawn: by its status until it is done, then by its verdict."""
    return F.when(status.isin("failed", "error"), "failed").when(~status.isin("done", "complete"), "pending").when(verdict == FAIL, "fail").when(verdict == WORK, "work").otherwise("nocall")


def skip_reason(labelled: Column, resistant: Column, susceptible: Column, with_features: Column) -> Column:
    """Why a drug can't be trained; the first that holds; null if it can."""
    return (
        F.when(with_features == 0, "no_amrfinder_features")
        .when(resistant == 0, "single_class_all_susceptible")
        .when(susceptible == 0, "single_class_all_resistant")
        .when(labelled < 15, "insufficient_labeled_genomes")
        .when(resistant < 3, "insufficient_resistant_examples")
    )


def quality_issues(n_test: Column, test_r: Column, test_s: Column, train_r: Column, recall_r: Column) -> Column:
    """Codes of what makes metrics doubtful."""
    return F.array_compact(
        F.array(
            F.when(n_test < 10, "small_test"),
            F.when(test_r == 0, "no_resistant_in_test"),
            F.when(test_s == 0, "no_susceptible_in_test"),
            F.when(train_r < 5, "few_resistant_in_train"),
            F.when((recall_r == 0.0) & (test_r > 0), "zero_resistant_recall"),
        )
    )


def logit_shift(p: Column, tau: Column) -> Column:
    """Move ``tau`` to one half; order stays."""
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    z = F.log(q / (1 - q)) - F.log(tau / (1 - tau))
    return 1 / (1 + F.exp(-z))
