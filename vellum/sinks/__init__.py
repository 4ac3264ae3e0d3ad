"""Writers.

``csv_export``     B1 CSV export
``landing``        B2, B3 gated, single-pass landing with a manifest row
``ledger_store``   B4-B7 ledger and external tables
``legacy_export``  F7 legacy pipe-delimited change logs
``snapshots``      key-bucketed snapshot tables
"""
