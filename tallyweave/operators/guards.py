"""Who may do what with an invoice or an order: Column builders that give the reason why not, null where it is allowed.

The first rule that is broken is the reason. Columns: role and name of the person and their approval_limit; the invoice's stage, status, removed,
touched (names of those who uploaded or corrected it) and total; the order's status, amount, requested_by and prepared_by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each role may do.
CAN = {
    "read": ("ap", "procurement", "approver", "admin", "service", "local", "viewer"), "upload": ("ap", "service", "local"), "edit": ("ap", "local"), "review": ("ap", "local"), "request": ("ap", "local"),
    "vendor_propose": ("ap", "procurement", "local"), "vendor_verify": ("procurement", "local"), "po": ("procurement", "local"), "receipt": ("procurement", "local"),
    "decide": ("approver", "admin", "local"), "manage": ("approver", "admin", "local"), "po_import": ("service", "local"),
}


def can(what: str, role: Column) -> Column:
    return F.coalesce(role.isin(*CAN[what]), F.lit(False))


def within_limit(amount: Column, limit: Column) -> Column:
    """No limit or no amount: allowed."""
    return limit.isNull() | amount.isNull() | (amount <= limit)


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), reason).otherwise(out)
    return out


def review(role: Column, stage: Column) -> Column:
    return _first((~can("review", role), "accounts payable reviews invoices"), (~stage.eqNullSafe(F.lit("ap_review")), "not waiting for the review"))


def approve(role: Column, name: Column, limit: Column, removed: Column, touched: Column, total: Column) -> Column:
    return _first(
        (~can("decide", role), "managers approve invoices"), (removed, "removed, so it is not paid"), (F.array_contains(touched, name), "you uploaded or corrected it"),
        (~within_limit(total, limit), "above your approval limit"),
    )


def remove(role: Column, removed: Column, status: Column) -> Column:
    return _first((~can("upload", role) & ~can("manage", role), "accounts payable or a manager removes"), (removed, "already removed"), (~status.eqNullSafe(F.lit("pending")), "already decided"))


def edit(role: Column, removed: Column, stage: Column) -> Column:
    return _first((~can("edit", role) | removed | ~stage.eqNullSafe(F.lit("ap_review")), "accounts payable corrects while reviewing"))


def approve_request(role: Column, name: Column, limit: Column, status: Column, amount: Column, requested_by: Column, prepared_by: Column) -> Column:
    return _first(
        (~can("decide", role), "managers approve orders"), (status.eqNullSafe(F.lit("requested")), "procurement prepares it first"), (~status.eqNullSafe(F.lit("prepared")), "already decided"),
        ((name == requested_by) | F.coalesce(name == prepared_by, F.lit(False)), "you requested or prepared it"), (~within_limit(amount, limit), "above your approval limit"),
    )
