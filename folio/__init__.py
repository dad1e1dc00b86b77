"""folio: DataFrame operators for corpora of annotated and recognised documents."""
