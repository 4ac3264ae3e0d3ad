"""DataFrame -> DataFrame operators.

``rename``      C1-C3 column-name cleaning
``profile``     C4-C6, C8, C15, D3, H6, H7, K4 type inference, profiles, facets, previews
``contract``    E1-E7 contract validation
``diff``        F1-F5, F2p, C9 snapshot diff into change records
``replay``      G1-G4, D5, D10 merge on read
``audit``       C11, C12, D4, D8, D9, H4, H5, K3 ledger analytics
``manifest``    C7, C10, C13, C14, D6, D7, H1-H3, J1, K1, K2 landed-file manifest
``materialize`` written, sized intermediates for size-checked joins
"""
