"""Every registered query, and the SQL it is compared with where SQL can say it."""

from turnstone.plans.catalog import conversations, quality, reports, search, sources, stores

TOPICS = (search, sources, conversations, quality, reports, stores)
QUERIES = {name: fn for topic in TOPICS for name, fn in topic.QUERIES.items()}
ORACLES = {name: sql for topic in TOPICS for name, sql in topic.ORACLES.items()}
