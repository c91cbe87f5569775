"""Physical-plan helpers: durable cuts of lineage, guarded broadcasts, table loading."""
