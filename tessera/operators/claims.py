"""Claims: status, summaries per patient, current payer, the nested patient record, and the answers built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules
from tessera.functions import text as tx

# Thresholds of the claim status, priorities, limits, answer texts.
PAID_RATIO, PENDING_RATIO, DENIED_COST, PENDING_COST = 0.95, 0.5, 100, 300
PRIORITY = {"DENIED_NO_PA": 0, "PENDING_P2P": 1, "PARTIAL": 2, "PAID": 3}
NEWEST_ENCOUNTERS = 20
PLAN_ABOVE = 500
OPEN_YEAR = 9999
PREP = {
    "colonoscopy": "For your colonoscopy, you must follow a clear liquid diet the day before. No solid food after midnight the night before your procedure. You will need to take a bowel prep solution as directed by your doctor — this is critical. Do not take blood thinners like aspirin or warfarin for 5 days before unless your doctor says otherwise. Arrange for someone to drive you home as you will be sedated.",
    "surgery": "For your surgery, do not eat or drink anything after midnight the night before. Stop blood thinners 5 days before unless your doctor instructs otherwise. Bring a list of all current medications to the hospital. Arrange for someone to drive you home. Arrive at least 2 hours before your scheduled procedure time for check-in and prep.",
    "cardiac": "For your cardiac procedure, take your regular medications with a small sip of water unless told otherwise. Do not eat or drink after midnight. Wear comfortable, loose clothing. Bring all your current medications and a list of any allergies. Someone must drive you home — you cannot drive yourself after sedation.",
    "imaging": "For your imaging scan, you may need to avoid eating for 4 hours beforehand depending on the type of scan. Remove all metal jewelry and piercings before arriving. If you have a pacemaker or metal implants, inform the technologist immediately. Wear comfortable clothing without metal fasteners.",
    "default": "For your upcoming procedure, please do not eat or drink anything after midnight the night before. Bring a photo ID, your insurance card, and a list of all current medications. Arrange for someone to drive you home if you will be receiving sedation or anesthesia. Arrive at least 30 minutes early for paperwork and check-in. If you have any questions about specific medications to stop, please call our nursing line.",
}


def claim_status(cost: Column, coverage: Column) -> Column:
    ratio = coverage / cost
    return (
        F.when(cost == 0, "PAID")
        .when(ratio >= PAID_RATIO, "PAID")
        .when((coverage == 0) & (cost > DENIED_COST), "DENIED_NO_PA")
        .when((coverage > 0) & (ratio < PENDING_RATIO) & (cost > PENDING_COST), "PENDING_P2P")
        .otherwise("PARTIAL")
    )


def priority(status: Column) -> Column:
    return rules.lookup(status, PRIORITY, F.lit(PRIORITY["PAID"]))


def summaries(claims: DataFrame, patient: str = "patient") -> DataFrame:
    """Per patient: totals over all claims, and how many are denied and pending. One shuffle, partly summed before it."""
    return claims.groupBy(patient).agg(
        F.sum("billed").alias("total_billed"),
        F.sum("covered").alias("total_covered"),
        (F.sum("billed") - F.sum("covered")).alias("total_owed"),
        F.count_if(F.col("status") == "DENIED_NO_PA").alias("denied_claims"),
        F.count_if(F.col("status") == "PENDING_P2P").alias("pending_claims"),
        F.count(F.lit(1)).alias("claims"),
    )


def worst_claims(claims: DataFrame, order: list[str], patient: str = "patient", newest: bool = False) -> DataFrame:
    """Per patient the claim of the worst status, of those the oldest (or newest); ``order`` breaks ties.

    An aggregate of the smallest row, so that rows are reduced before the shuffle.
    """
    row = [c for c in claims.columns if c != patient]
    return claims.groupBy(patient).agg(worst_claim(row, order, newest).alias("top")).select(patient, "top.*")


def worst_claim(columns: list[str], order: list[str], newest: bool = False) -> Column:
    """``worst_claims`` as an aggregate: a struct of the worst claim's ``columns``."""
    date = -F.unix_date(F.col("date")) if newest else F.unix_date(F.col("date"))
    key = F.struct(priority(F.col("status")).alias("p"), date.alias("d"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return F.min_by(F.struct(*[F.col(c) for c in columns]), key)


def latest(rows: DataFrame, key: str, order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in the given order. Spark keeps only ``n`` of each key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def current_payers(transitions: DataFrame, key: str = "patient", end: str = "end_year", tie: str = "start_year") -> DataFrame:
    """Per patient the transition that ends last; one without an end is open and wins."""
    return latest(transitions, key, [F.coalesce(F.col(end), F.lit(OPEN_YEAR)).desc(), F.col(tie)]).drop("rank")


def active_conditions(conditions: DataFrame, order: list[str]) -> DataFrame:
    """Conditions that have not stopped, the first of each patient and code."""
    open_ = conditions.filter(F.coalesce(tx.strip(F.col("stop")), F.lit("")) == "")
    w = Window.partitionBy("patient", "code").orderBy(*order)
    return open_.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def patient_records(patients: DataFrame, encounters: DataFrame, conditions: DataFrame, payers: DataFrame, order: list[str]) -> DataFrame:
    """One nested record per patient: insurance, active conditions, the newest encounters, and the summary of all."""
    newest = latest(encounters, "patient", [F.col("date").desc(), *[F.col(c) for c in order]], NEWEST_ENCOUNTERS)
    fields = [c for c in encounters.columns if c != "patient"]
    told = newest.groupBy("patient").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda e: F.struct(*[e[c].alias(c) for c in fields])).alias("encounters"))
    active = active_conditions(conditions, ["onset", "description"]).groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("onset", "code", "description"))).alias("active_conditions"))
    totals = summaries(encounters)
    insured = current_payers(payers).select("patient", F.struct("payer", F.col("start_year").alias("member_since")).alias("insurance"))
    summary = F.struct("total_billed", "total_covered", "total_owed", "denied_claims", "pending_claims").alias("claim_summary")
    joined = patients.join(told, "patient", "left").join(active, "patient", "left").join(insured, "patient", "left").join(totals, "patient", "left")
    return joined.select(*[patients[c] for c in patients.columns], "insurance", "active_conditions", "encounters", summary)


def plural(n: Column) -> Column:
    return F.when(n > 1, "s").otherwise("")


def status_answer() -> Column:
    """From the columns of a worst claim joined to its patient's summary, with name, payer and description."""
    c = F.col
    opening = F.concat(c("name"), F.lit(", your "), c("description"), F.lit(" claim from "), c("date").cast("string"))
    denied = F.concat(
        opening, F.lit(" was denied — prior authorization not obtained. Billed: "), tx.money(c("billed")), F.lit(", covered: $0. To appeal: your care team submits a prior auth request to "), c("payer"),
        F.lit(". If denied again, your doctor can request a Peer-to-Peer review."), F.when(c("denied_claims") > 1, F.concat(F.lit(" You have "), c("denied_claims").cast("string"), F.lit(" total denied claims."))).otherwise(""),
    )
    pending = F.concat(opening, F.lit(" is pending a Peer-to-Peer review with "), c("payer"), F.lit(". Your doctor needs to speak with the insurer's medical director. Billed: "), tx.money(c("billed")), F.lit(", potentially covered: "), tx.money(c("covered")), F.lit(". Typically resolves in 3-5 business days."))
    partial = F.concat(opening, F.lit(" was partially covered. "), c("payer"), F.lit(" paid "), tx.money(c("covered")), F.lit(" of "), tx.money(c("billed")), F.lit(". Your balance: "), tx.money(c("owes")), F.lit("."))
    others = F.concat(F.lit(" However, you do have "), c("denied_claims").cast("string"), F.lit(" other denied claim"), plural(c("denied_claims")), F.lit(" on your account that may need attention."))
    paid = F.concat(
        c("name"), F.lit(", your most recent claim for "), c("description"), F.lit(" on "), c("date").cast("string"), F.lit(" was fully processed. "), c("payer"), F.lit(" covered "), tx.money(c("covered")), F.lit(" of the "), tx.money(c("billed")), F.lit(" billed. "),
        F.when(c("denied_claims") > 0, others).otherwise("All your recent claims appear to be in order."),
    )
    return F.when(c("status") == "DENIED_NO_PA", denied).when(c("status") == "PENDING_P2P", pending).when(c("status") == "PARTIAL", partial).otherwise(paid)


def paid_coverage(claims: DataFrame, patient: str | None = None) -> DataFrame:
    """Mean share that paid claims had covered."""
    paid = claims.filter((F.col("status") == "PAID") & (F.col("billed") > 0))
    return (paid.groupBy(patient) if patient else paid.groupBy()).agg(F.avg(F.col("covered") / F.col("billed")).alias("coverage"))


def cost_answer() -> Column:
    c = F.col
    summary = F.concat(c("name"), F.lit(", billing summary with "), c("payer"), F.lit(": total billed "), tx.money(c("total_billed")), F.lit(", covered "), tx.money(c("total_covered")), F.lit(", your responsibility "), tx.money(c("total_owed")), F.lit("."))
    denied = F.when(c("denied_claims") > 0, F.concat(F.lit(" "), c("denied_claims").cast("string"), F.lit(" denied claim"), plural(c("denied_claims")), F.lit(" may be adding to your balance — our billing team can review."))).otherwise("")
    return F.when(c("total_billed") == 0, "No billing history on file. Contact our billing department directly.").otherwise(F.concat(summary, denied, F.lit(" For a procedure-specific estimate, call our financial counselors.")))


def bill_answer() -> Column:
    """Needs also denied_total and partial_claims."""
    c = F.col
    head = F.concat(c("name"), F.lit(", your bill: "), tx.money(c("total_billed")), F.lit(" billed, "), c("payer"), F.lit(" paid "), tx.money(c("total_covered")), F.lit(", you owe "), tx.money(c("total_owed")), F.lit(". "))
    denied = F.when(c("denied_claims") > 0, F.concat(tx.money(c("denied_total")), F.lit(" from "), c("denied_claims").cast("string"), F.lit(" denied claim"), plural(c("denied_claims")), F.lit(" — prior auth not obtained. You can appeal these. "))).otherwise("")
    partial = F.when(c("partial_claims") > 0, F.concat(F.lit("Remaining balance is your deductible/coinsurance share under your "), c("payer"), F.lit(" plan. "))).otherwise("")
    tail = F.when(c("total_owed") > PLAN_ABOVE, "We offer payment plans — contact billing to set one up.").otherwise(F.concat(F.lit("You can pay your balance of "), tx.money(c("total_owed")), F.lit(" online at our patient portal, by phone, or in person at the billing office.")))
    return F.when((c("total_owed") == 0) & (c("total_billed") == 0), "No outstanding billing records found. Call billing with your bill reference number.").otherwise(F.concat(head, denied, partial, tail))


def prep_answer() -> Column:
    """From name, description, reason, encounter_type and date of the latest encounter."""
    c = F.col
    kind = rules.prep_kind(F.concat_ws(" ", c("description"), c("reason")), c("encounter_type"))
    return F.concat(c("name"), F.lit(", for your "), c("description"), F.coalesce(F.concat(F.lit(" on "), c("date").cast("string")), F.lit("")), F.lit(": "), rules.lookup(kind, PREP, F.lit(PREP["default"])))
