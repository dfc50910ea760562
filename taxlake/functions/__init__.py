"""Column -> Column building blocks: money, periods, tariff, VAT rules, review, text."""
