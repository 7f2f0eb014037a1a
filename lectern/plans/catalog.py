"""Every query of the engine itself, with its oracle where SQL can express it."""

from lectern.plans import analysis, roll_ups, store, texts

QUERIES = roll_ups.QUERIES | texts.QUERIES | analysis.QUERIES | store.QUERIES
SQL = roll_ups.SQL | texts.SQL | analysis.SQL | store.SQL
