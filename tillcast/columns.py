"""Names of the columns the operators read.

Every operator takes its column names from a :class:`SalesColumns`, so the
same code serves the landed workbook sheets and any other table of invoice
lines (the test adapter maps the star-schema tables onto it).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SalesColumns:
    date: str = "invoice_date"          # Invoice Date (timestamp)
    material: str = "material_no"       # Material No (string key)
    qty: str = "sal_qty"                # SalQty (double)
    value: str = "sale_value"           # SaleValue (decimal(18,2), the target)
    category: str = "category"
    sku: str = "sku"
    short_name: str | None = "short_name"        # optional sheet column
    material_name: str | None = "material_name"  # optional sheet column
    vendor: str = "vendor"
    type: str = "type"
    soh: str = "soh"
    indent: str = "indent"
    crt_size: str = "crt_size"
    no_crts: str = "no_crts"
    # Total order of the invoice lines: the date first, then columns that make
    # ties inside a day deterministic (the reference's sort is unstable).
    order: tuple[str, ...] = ("invoice_date",)
    # Optional keys of independent daily series (for example one per shop).
    series_keys: tuple[str, ...] = field(default_factory=tuple)

    def text_columns(self) -> list[str]:
        """Columns that get label codes, in the reference's order."""
        cols = [self.category, self.sku, self.vendor, self.type,
                self.short_name, self.material_name]
        return [c for c in cols if c]
