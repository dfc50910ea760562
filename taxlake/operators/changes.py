"""Batch state changes: documents joined with a change table give new documents and audit rows.

A change is (id, change_id, at, kind, field, value). Kinds: patch (one field), payment (value:
invoice_date, not_paid, unknown, or an ISO date), direction, treatment, confirm, delete, restore,
purge. ``resolve`` puts the changes of a document in order and gives each its fate; the live ones make
the new state, the audit rows and the outcome, the others are the reject output. All of it needs the
changes dealt by document once: the windows, the reduction and the join share that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxlake.functions import review
from taxlake.functions.periods import assigned_period
from taxlake.functions.vat import applicable
from taxlake.operators.classification import classify
from taxlake.session import possibly_named

# patchable document field -> (column, type)
PATCH_FIELDS = {
    "invoiceNumber": ("invoice_number", "string"),
    "invoiceDate": ("invoice_date", "date"),
    "issuerName": ("issuer_name", "string"),
    "issuerCountryCode": ("issuer_country_code", "string"),
    "issuerVatId": ("issuer_vat_id", "string"),
    "recipientName": ("recipient_name", "string"),
    "recipientCountryCode": ("recipient_country_code", "string"),
    "recipientVatId": ("recipient_vat_id", "string"),
    "recipientIsBusiness": ("recipient_is_business", "boolean"),
    "description": ("description", "string"),
    "originalCurrency": ("original_currency", "string"),
    "netAmountOriginal": ("net_amount_original", "decimal(18,2)"),
    "vatAmountOriginal": ("vat_amount_original", "decimal(18,2)"),
    "grossAmountOriginal": ("gross_amount_original", "decimal(18,2)"),
    "exchangeRateToEur": ("exchange_rate_to_eur", "decimal(18,10)"),
}
# fields that a new reading gives -> column
READ_FIELDS = {
    **{f: c for f, (c, _) in PATCH_FIELDS.items() if f != "exchangeRateToEur"},
    "serviceDateFrom": "service_date_from", "serviceDateTo": "service_date_to", "dueDate": "due_date",
    "issuerAddress": "issuer_address", "issuerTaxNumber": "issuer_tax_number", "recipientAddress": "recipient_address",
}
# what follows from them -> column
DEPENDENT_FIELDS = {
    "exchangeRateToEur": "exchange_rate_to_eur", "netAmountEur": "net_amount_eur", "vatAmountEur": "vat_amount_eur",
    "grossAmountEur": "gross_amount_eur", "vatTreatmentCode": "vat_treatment_code",
}
_EVENT_TYPES = {
    "patch": "manual_correction", "payment": "payment_date_change", "direction": "direction_change",
    "treatment": "tax_classification_change", "confirm": "confirm", "delete": "delete",
    "restore": "restore", "purge": "hard_delete",
}


def _payment(mode: Column, invoice_date: Column) -> Column:
    """struct<value, status>: date and state that a payment change asks for; null if it can't be met."""
    paid_on = F.when(mode == "invoice_date", invoice_date).otherwise(mode.try_cast("date"))
    status = F.when(mode == "not_paid", "unpaid").when(mode == "unknown", "unknown").when(paid_on.isNotNull(), "paid")
    date = F.when(status == "paid", paid_on.cast("string"))
    return F.when(status.isNotNull(), F.struct(date.alias("value"), status.alias("status")))


def resolve(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change with ``step`` (its place among those of its document), ``before``, ``after``, ``fate``.

    Order: ``at`` (null first), then ``change_id``. Fates: ``live``; ``same`` (asks for what is there);
    ``in_trash`` and ``not_in_trash``; ``purged`` (the document is gone by then); ``invalid`` (unknown kind,
    field or value, no invoice date to pay on, a treatment that doesn't suit the direction of that
    moment); ``unknown_document``. ``before`` and ``after`` are struct<value, status>, dates and numbers as
    text. The previous code of a treatment is the last one chosen or stored: codes that were derived
    anew within the batch are not replayed. The changes of one document are sorted by one task (on
    disk if need be) and never gathered in a row.
    """
    stored = {f: c for f, (c, _) in PATCH_FIELDS.items() if c in documents.columns}
    facts = documents.select(
        "id", F.lit(True).alias("_known"), F.col("deleted_at").isNotNull().alias("_deleted"),
        F.col("direction").alias("_direction"), F.col("vat_treatment_code").alias("_code"), F.col("invoice_date").alias("_date"),
        F.struct(F.col("payment_date").cast("string").alias("value"), F.col("payment_status").alias("status")).alias("_paid"),
        *[F.col(c).cast("string").alias(f"_stored_{f}") for f, c in stored.items()],
    )
    facts = possibly_named(facts, changes)
    kind, field, value = F.col("kind"), F.col("field"), F.col("value")
    plain = lambda c: F.struct(c.alias("value"), F.lit(None).cast("string").alias("status"))
    by_field = lambda pick: F.coalesce(*[F.when(field == f, pick(f)) for f in stored]) if stored else F.lit(None).cast("string")
    key = F.when(kind == "patch", F.concat(F.lit("patch:"), F.coalesce(field, F.lit("")))).when(
        kind.isin("delete", "restore"), "trash"
    ).otherwise(kind)
    rows = (
        changes.select("id", "change_id", "at", "kind", "field", "value")
        .join(facts, "id", "left")
        .withColumns(
            {
                "_known": F.coalesce("_known", F.lit(False)),
                "_key": key,
                "_typed": by_field(lambda f: value.try_cast(PATCH_FIELDS[f][1]).cast("string")),
                "_stored": F.when(kind == "patch", plain(by_field(lambda f: F.col(f"_stored_{f}"))))
                .when(kind == "direction", plain(F.col("_direction")))
                .when(kind == "treatment", plain(F.col("_code")))
                .when(kind == "payment", F.col("_paid")),
            }
        )
        .drop(*[f"_stored_{f}" for f in stored])
    )
    in_order = W.partitionBy("id").orderBy("at", "change_id")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(earlier)
    rows = (
        rows.withColumns(
            {
                "step": F.row_number().over(in_order),
                "_trashed": F.coalesce(last(F.when(kind.isin("delete", "restore"), kind == "delete")), "_deleted", F.lit(False)),
            }
        )
        .withColumn("_gone", F.coalesce(F.max((kind == "purge") & F.col("_trashed")).over(earlier), F.lit(False)))
        .withColumn("_open", ~F.col("_trashed") & ~F.col("_gone"))
    )
    patch_fits = F.coalesce((kind == "patch") & field.isin(*stored) & (value.isNull() | F.col("_typed").isNotNull()), F.lit(False))
    turn_fits = F.coalesce((kind == "direction") & value.isin("income", "expense"), F.lit(False))
    dated = F.when(F.col("_open") & patch_fits & (field == "invoiceDate"), F.struct(F.col("_typed").cast("date").alias("date")))
    rows = rows.withColumns(
        {
            "_direction": F.coalesce(last(F.when(F.col("_open") & turn_fits, value)), "_direction"),
            "_date": F.coalesce(last(dated), F.struct(F.col("_date").alias("date")))["date"],
        }
    ).withColumn(
        "after",
        F.when(patch_fits, plain(F.col("_typed")))
        .when(turn_fits, plain(value))
        .when((kind == "treatment") & applicable(F.col("_direction"), value), plain(value))
        .when(kind == "payment", _payment(value, F.col("_date"))),
    )
    fits = F.coalesce(F.col("after").isNotNull() | kind.isin("confirm", "delete", "restore", "purge"), F.lit(False))
    chain = W.partitionBy("id", "_key").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("_open"), F.col("after")), ignorenulls=True).over(chain), F.col("_stored"))
    fate = (
        F.when(~F.col("_known"), "unknown_document")
        .when(F.col("_gone"), "purged")
        .when(F.coalesce(kind.isin("restore", "purge"), F.lit(False)), F.when(F.col("_trashed"), "live").otherwise("not_in_trash"))
        .when(F.col("_trashed"), "in_trash")
        .when(~fits, "invalid")
        .when(kind.isin("patch", "payment", "direction") & F.col("after").eqNullSafe(F.col("before")), "same")
        .otherwise("live")
    )
    return rows.withColumn("before", before).select(
        "id", "change_id", "at", "kind", "field", "value", "step", F.col("_key").alias("key"), "before", "after", fate.alias("fate")
    )


def collapse(resolved: DataFrame) -> DataFrame:
    """One row per document: ``changes`` map of key -> struct(step, at, kind, after) of the last live change.

    Keys are the kinds, "patch:field" and "trash" (delete and restore), which bounds the map. ``rejected``
    tells whether any change was invalid.
    """
    latest = resolved.groupBy("id", "key").agg(
        F.max(F.when(F.col("fate") == "live", F.struct("step", "at", "kind", "after"))).alias("c"),
        F.max(F.col("fate") == "invalid").alias("rejected"),
    )
    entry = F.when(F.col("c").isNotNull(), F.struct("key", "c"))
    return latest.groupBy("id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("changes"), F.max("rejected").alias("_rejected")
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """Current version of every document in a table of versions, purged documents left out.

    Where versions have the ``batch_id`` they were committed with, that comes before ``updated_at``; a
    row with ``purged`` set is a tombstone.
    """
    columns = [c for c in versions.columns if c != "id"]
    order = [c for c in ("batch_id", "updated_at") if c in columns]
    current = versions.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select("id", "v.*")
    if "purged" not in columns:
        return current
    return current.filter(~F.coalesce("purged", F.lit(False))).drop("purged")


def only_unchanged(updates: DataFrame, documents: DataFrame) -> DataFrame:
    """Updates whose ``read_at`` still is the stored ``updated_at`` of a document not deleted."""
    current = documents.filter(F.col("deleted_at").isNull()).select(
        "id", F.col("updated_at").alias("read_at")
    )
    return updates.join(current, ["id", "read_at"], "left_semi")


def audit_trail(events: DataFrame) -> DataFrame:
    """Number the audit events of a document by time."""
    order = W.partitionBy("document_id").orderBy("created_at", "event_id")
    return events.withColumn("step", F.row_number().over(order))


def apply_changes(
    documents: DataFrame, changes: DataFrame, rates: DataFrame | None = None, today: Column | None = None
) -> DataFrame:
    """The documents that changes name, in their new state, with ``outcome`` and the confirmation.

    With ``rates``, an edited document in a foreign currency that has no rate gets the official one of its
    invoice date, or of ``today`` without a date.

    ``changes`` are raw or already resolved. Needs ``vat_method`` next to the documents (for the
    classification). Rows without changes do not appear; purged rows appear with the outcome ``purged``
    and no longer belong to the table. ``updated_at`` always moves on when a row changes, also by a
    change that comes late, so that it can serve as the version that a writer has read.
    """
    resolved = changes if "fate" in changes.columns else resolve(documents, changes)
    rows = possibly_named(documents, changes).join(collapse(resolved), "id")
    change = lambda key: F.try_element_at("changes", F.lit(key))
    trash, purged = change("trash"), change("purge").isNotNull()

    columns = {c: f for f, (c, _) in PATCH_FIELDS.items() if c in documents.columns}
    patches = {c: change(f"patch:{f}") for c, f in columns.items()}
    newest = lambda part: F.array_max(F.array(*[p[part] for p in (*patches.values(), change("direction"), change("treatment"))]))
    payment = change("payment")
    rows = rows.withColumns(
        {
            "_changed": F.array_compact(F.array(*[F.when(patches[c].isNotNull(), F.lit(f)) for c, f in columns.items()])),
            "_edited_step": newest("step"),
            "_edited_at": newest("at"),
            "_turned": change("direction").isNotNull(),
            "_payment": payment,
            "_old_status": F.col("review_status"),
        }
    ).withColumns(
        {
            "direction": F.coalesce(change("direction")["after"]["value"], F.col("direction")),
            **{
                c: F.when(p.isNotNull(), p["after"]["value"].cast(PATCH_FIELDS[columns[c]][1])).otherwise(F.col(c))
                for c, p in patches.items()
            },
            "payment_date": F.when(payment.isNotNull(), payment["after"]["value"].cast("date")).otherwise(F.col("payment_date")),
            "payment_status": F.coalesce(payment["after"]["status"], "payment_status"),
        }
    )
    rows = _derived(rows, documents.columns, rates, today)

    # review state: edits ask for a new confirmation, a later confirm needs a clean document
    confirm = change("confirm")
    confirms = confirm.isNotNull() & (confirm["step"] > F.coalesce("_edited_step", F.lit(0)))
    clean = ~F.exists("_core", lambda i: i["severity"] == "critical")
    edited = F.col("_edited_step").isNotNull()
    rows = rows.withColumns({"_confirmed": confirms & clean, "_blocked": confirms & ~clean})
    confirmed_at = F.when(F.col("_confirmed"), confirm["at"])
    moved = F.greatest("_edited_at", payment["at"], confirmed_at, trash["at"], change("purge")["at"])
    touched = edited | payment.isNotNull() | F.col("_confirmed") | trash.isNotNull() | purged
    outcome = (
        F.when(purged, "purged")
        .when(trash["kind"] == "delete", "deleted")
        .when(trash["kind"] == "restore", "restored")
        .when(F.col("_blocked"), "confirm_blocked")
        .when(touched, "updated")
        .when(F.col("_rejected"), "rejected")
        .otherwise("skipped")
    )
    return rows.withColumns(
        {
            "confirmed_at": confirmed_at,
            "confirmed_from": F.when(F.col("_confirmed"), F.when(edited, "needs_review").otherwise(F.col("_old_status"))),
            "review_status": F.when(F.col("_confirmed"), "confirmed").when(edited, "needs_review").otherwise(F.col("review_status")),
            "outcome": outcome,
            "changed": touched,
            "updated_at": F.when(
                touched, F.greatest(moved, F.col("updated_at") + F.expr("INTERVAL 0.000001 SECOND"))
            ).otherwise(F.col("updated_at")),
            "deleted_at": F.when(trash["kind"] == "delete", trash["at"]).when(trash.isNull(), F.col("deleted_at")),
        }
    ).select(*documents.columns, "review_reasons", "outcome", "changed", "confirmed_at", "confirmed_from")


def _derived(rows: DataFrame, columns: list[str], rates: DataFrame | None, today: Column | None) -> DataFrame:
    """What follows from the edited fields: treatment, EUR amounts, period, issues, evidence."""
    from taxlake.operators.currency import resolve_rates, with_eur_amounts

    edited = F.size("_changed") > 0
    if rates is not None:
        rows = resolve_rates(rows, rates, F.current_date() if today is None else today)
        lacking = edited & F.col("exchange_rate_to_eur").isNull()
        found = {"exchange_rate_to_eur": "rate_to_eur", "exchange_rate_date": "rate_date", "exchange_rate_source": "source"}
        rows = rows.withColumns(
            {c: F.when(lacking, F.col(f"rate.{part}")).otherwise(F.col(c)) for c, part in found.items() if c in columns}
        ).drop("rate", "rate_needed", "rate_missing")
    manual = F.coalesce(F.col("manual_override"), F.lit(False)) if "manual_override" in columns else F.lit(False)
    reclassified = F.col("_turned") | (edited & ~manual)
    chosen, turned = (F.try_element_at("changes", F.lit(k)) for k in ("treatment", "direction"))
    by_hand = chosen.isNotNull() & (chosen["step"] > F.coalesce(turned["step"], F.lit(0)))
    rows = classify(rows).withColumn(
        "vat_treatment_code",
        F.when(by_hand, chosen["after"]["value"])
        .when(reclassified, F.col("vat_classification.code"))
        .otherwise(F.col("vat_treatment_code")),
    )
    if "manual_override" in columns:
        rows = rows.withColumn(
            "manual_override", F.when(by_hand, True).when(F.col("_turned"), False).otherwise(F.col("manual_override"))
        )
    amounts = ["net_amount_eur", "vat_amount_eur", "gross_amount_eur"]
    rows = rows.withColumns({f"_kept_{c}": F.col(c) for c in amounts})
    rows = with_eur_amounts(
        rows.withColumn("rate", F.struct(F.col("exchange_rate_to_eur").alias("rate_to_eur")))
    ).withColumns({c: F.when(edited, F.col(c)).otherwise(F.col(f"_kept_{c}")) for c in amounts})
    rows = rows.withColumns(
        {
            "exchange_rate_to_eur": F.when(
                edited & (F.upper("original_currency") == "EUR"), F.lit(None)
            ).otherwise(F.col("exchange_rate_to_eur")),
            **{f"tax_period_{part}": assigned_period(F.col("invoice_date"))[part] for part in ("year", "quarter", "month")},
        }
    )
    rows = rows.withColumn("_before", F.col("issues"))
    rows = review.drop_field_evidence(rows, F.col("_changed"))
    rows = review.drop_resolved(rows)
    rows = rows.withColumn("_dropped", F.col("issues"))
    rows = review.core_issues(rows).withColumn("_core", F.col("issues"))
    return rows.withColumn(
        "issues",
        F.when(edited, F.col("_core"))
        .when(F.col("_payment").isNotNull(), F.col("_dropped"))
        .otherwise(F.col("_before")),
    ).withColumn(
        "review_reasons",
        F.when(
            by_hand & (chosen["step"] == F.col("_edited_step")),
            F.array_except(review.reasons(), F.array(F.lit("vat_classification_unconfirmed"))),
        ).otherwise(review.reasons()),
    )


def audit_rows(resolved: DataFrame, changed: DataFrame) -> DataFrame:
    """(document_id, change_id, event_type, previous_value, next_value, at), values as JSON text.

    One row per live change. A confirmation that a later edit in the batch undoes, or that critical
    issues block, has none: only the one that holds at the end is known to have been possible.
    """
    kind, before, after = F.col("kind"), F.col("before"), F.col("after")
    pair = lambda name, c: F.to_json(F.struct(c["value"].alias(name)))
    paid = lambda c: F.to_json(F.struct(c["value"].alias("payment_date"), c["status"].alias("payment_status")))
    patched = lambda c: F.to_json(F.struct(F.col("field"), c["value"].alias("value")))

    def told(c: Column) -> Column:
        return (
            F.when(kind == "patch", patched(c))
            .when(kind == "payment", paid(c))
            .when(kind == "direction", pair("direction", c))
            .when(kind == "treatment", pair("vat_treatment_code", c))
        )

    event = F.coalesce(*[F.when(kind == k, F.lit(e)) for k, e in _EVENT_TYPES.items()])
    live = resolved.filter((F.col("fate") == "live") & (kind != "confirm")).select(
        F.col("id").alias("document_id"),
        "change_id",
        event.alias("event_type"),
        told(before).alias("previous_value"),
        F.coalesce(told(after), F.when(kind == "delete", F.lit('{"trashed":true}'))).alias("next_value"),
        "at",
    )
    # exploded and not filtered at once: a filter would be pushed down with a copy of the whole review
    held = F.when(F.col("confirmed_at").isNotNull(), F.array(F.struct(F.col("confirmed_from").alias("review_status"), F.col("confirmed_at").alias("at"))))
    confirmed = changed.select("id", F.explode_outer(held).alias("c")).filter(F.col("c").isNotNull()).select(
        F.col("id").alias("document_id"),
        F.lit(None).cast(live.schema["change_id"].dataType).alias("change_id"),
        F.lit(_EVENT_TYPES["confirm"]).alias("event_type"),
        F.to_json(F.struct("c.review_status")).alias("previous_value"),
        F.lit('{"review_status":"confirmed"}').alias("next_value"),
        "c.at",
    )
    return live.unionByName(confirmed)


def rejected_changes(resolved: DataFrame) -> DataFrame:
    """Changes that did nothing, with the reason."""
    return resolved.filter(F.col("fate") != "live").select("id", "change_id", "at", "kind", "field", "value", F.col("fate").alias("reason"))


def lifecycle_counts(changed: DataFrame) -> DataFrame:
    """How many documents ended with each outcome."""
    return changed.groupBy("outcome").agg(F.count("*").alias("documents"))


def settings_diff(stored: DataFrame, wanted: DataFrame, key: str = "tenant_id") -> DataFrame:
    """One row per changed setting: tenant, field, previous value, next value."""
    fields = [c for c in wanted.columns if c != key and c in stored.columns]

    def pairs(alias: str) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields])
        ).alias(alias)

    joined = stored.select(key, pairs("old")).join(wanted.select(key, pairs("new")), key)
    changed = F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.try_element_at("old", k)))
    return joined.select(key, "old", F.explode(changed).alias("field", "next_value")).select(
        key, "field", F.try_element_at("old", F.col("field")).alias("previous_value"), "next_value"
    )


def corrected_fields(audit: DataFrame) -> DataFrame:
    """document id -> set of fields its user corrected by hand (bounded by the field list)."""
    field = F.get_json_object("next_value", "$.field")
    hits = audit.filter((F.col("event_type") == "manual_correction") & (F.col("source") == "user"))
    return hits.groupBy(F.col("document_id").alias("id")).agg(F.collect_set(field).alias("corrected"))


def merge_reextraction(documents: DataFrame, extracted: DataFrame, audit: DataFrame) -> DataFrame:
    """New readings replace old fields except those the user corrected.

    Deleted and confirmed rows are skipped; ``extracted`` carries ``read_at``, the version it was
    made from, and only updates rows that are still at it. Adds ``changed_fields``.
    """
    columns = {c: f for f, c in READ_FIELDS.items() if c in documents.columns and c in extracted.columns}
    fresh = extracted.select(
        "id", F.col("read_at").alias("updated_at"), *[F.col(c).alias(f"_x_{c}") for c in columns],
        F.col("field_confidence").alias("_x_confidence"), F.col("issues").alias("_x_issues"),
        *([F.col("vat_rates").alias("_x_vat_rates")] if "vat_rates" in extracted.columns else []),
    )
    open_rows = documents.filter(F.col("deleted_at").isNull() & (F.col("review_status") != "confirmed"))
    rows = (
        open_rows.join(fresh, ["id", "updated_at"])
        .join(corrected_fields(audit), "id", "left")
        .withColumn("corrected", F.coalesce("corrected", F.array().cast("array<string>")))
    )
    keep = {c: F.array_contains("corrected", f) for c, f in columns.items()}
    changed = F.array_compact(
        F.array(
            *[F.when(~keep[c] & ~F.col(f"_x_{c}").eqNullSafe(F.col(c)), F.lit(f)) for c, f in columns.items()]
        )
    )
    rows = rows.withColumn("changed_fields", changed).withColumns(
        {c: F.when(keep[c], F.col(c)).otherwise(F.col(f"_x_{c}")) for c in columns}
    )
    canonical = F.transform("corrected", review.canonical_field)
    rows = rows.withColumns(
        {
            "field_confidence": F.map_filter(
                "_x_confidence", lambda k, _: ~F.array_contains(canonical, review.canonical_field(k))
            ),
            "issues": F.col("_x_issues"),
            **({"vat_rates": F.col("_x_vat_rates")} if "vat_rates" in extracted.columns and "vat_rates" in documents.columns else {}),
            "review_status": F.lit("needs_review"),
            "tax_period_year": F.year("invoice_date"),
            "tax_period_quarter": F.quarter("invoice_date"),
            "tax_period_month": F.month("invoice_date"),
        }
    )
    return rows.select(*documents.columns, "changed_fields")


def reextract(documents: DataFrame, extracted: DataFrame, audit: DataFrame, rates: DataFrame, today: Column) -> DataFrame:
    """``merge_reextraction`` with all that depends on the merged fields.

    A rate entered by hand stays, every other one is looked up anew for the merged currency and date; EUR amounts
    follow. The treatment is classified anew unless the user chose it. A foreign currency without a rate is an
    issue. ``documents`` carries ``vat_method``; ``changed_fields`` also names the dependent values that moved.
    """
    from taxlake.operators.currency import resolve_rates, with_eur_amounts

    merged = merge_reextraction(documents, extracted, audit)
    before = documents.select("id", *[F.col(c).alias(f"_was_{c}") for c in DEPENDENT_FIELDS.values()])
    by_hand = F.lit(False)
    if "exchange_rate_source" in documents.columns:
        by_hand = (F.col("exchange_rate_source") == "manual") & F.col("exchange_rate_to_eur").isNotNull()
    text = "extracted_text" if "extracted_text" in documents.columns else None
    rows = resolve_rates(merged.withColumn("_by_hand", F.coalesce(by_hand, F.lit(False))), rates, today, text)
    stored = F.struct(
        F.col("exchange_rate_to_eur").alias("rate_to_eur"), F.col("rate.rate_date").alias("rate_date"), F.lit("manual").alias("source")
    )
    rows = with_eur_amounts(rows.withColumn("rate", F.when(F.col("_by_hand"), stored).otherwise(F.col("rate"))))
    lacking = F.col("rate_missing") & ~F.col("_by_hand")
    missing = F.struct(
        F.lit("missing_exchange_rate").alias("code"), F.lit("critical").alias("severity"), F.lit("issues.missing_exchange_rate").alias("message_key"),
        F.lit("exchangeRateToEur").alias("field"), F.lit(None).cast("map<string,string>").alias("params"),
    ).cast(review.ISSUE_TYPE)
    chosen = F.coalesce(F.col("manual_override"), F.lit(False)) if "manual_override" in documents.columns else F.lit(False)
    rows = classify(rows).withColumns(
        {
            "exchange_rate_to_eur": F.when(F.col("_by_hand"), F.col("exchange_rate_to_eur")).otherwise(F.col("rate.rate_to_eur")),
            "vat_treatment_code": F.when(chosen, F.col("vat_treatment_code")).otherwise(F.col("vat_classification.code")),
            "issues": F.when(lacking, F.concat("issues", F.array(missing))).otherwise(F.col("issues")),
        }
    )
    for name, value in (("exchange_rate_source", F.col("rate.source")), ("exchange_rate_date", F.col("rate.rate_date"))):
        if name in documents.columns:
            rows = rows.withColumn(name, F.when(F.col("_by_hand"), F.col(name)).otherwise(value))
    rows = rows.join(before, "id")
    moved = [F.when(~F.col(c).eqNullSafe(F.col(f"_was_{c}")), F.lit(f)) for f, c in DEPENDENT_FIELDS.items()]
    changed = F.concat("changed_fields", F.array_compact(F.array(*moved)))
    return rows.withColumns({"changed_fields": changed, "review_reasons": review.reasons()}).select(
        *documents.columns, "changed_fields", "review_reasons"
    )


def reextraction_audit(reextracted: DataFrame, version: str, at: Column) -> DataFrame:
    """One audit row per document read anew: which fields it changed, forty at most."""
    return reextracted.select(
        F.col("id").alias("document_id"), F.lit("re_extraction").alias("event_type"),
        F.to_json(F.struct(F.lit(version).alias("extractionVersion"), F.slice("changed_fields", 1, 40).alias("changedFields"))).alias("next_value"),
        at.alias("created_at"), F.lit("user").alias("source"),
    )
