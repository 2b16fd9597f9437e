"""Data audits and data processing as PySpark DataFrame operators."""

import importlib

_EXPORTS = {
    "auditframe.config": ("InvalidInventoryError", "InvalidPolicyError"),
    "auditframe.report": (
        "audit_csv", "audit_inventory_policy", "audit_jsonl", "audit_sqlite", "audit_text_file", "audit_zip", "build_inventory", "compare_inventories", "find_duplicates", "load_inventory", "load_policy", "verify_directory",
    ),
}
_HOMES = {name: module for module, exported in _EXPORTS.items() for name in exported}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:
        return getattr(importlib.import_module(_HOMES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
