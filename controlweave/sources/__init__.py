"""Evidence tables in, ledger tables out."""
