"""Evidence-ledger analytics on Spark: many conflicting documents about an entity, one traced record."""
