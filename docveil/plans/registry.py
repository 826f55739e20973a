"""All queries by name, each with its SQL, if SQL can say it."""

from docveil.plans import bilingual, contracts, jsons, packages, places, queries, spellings

QUERIES = queries.QUERIES | places.QUERIES | spellings.QUERIES | contracts.QUERIES | packages.QUERIES | jsons.QUERIES | bilingual.QUERIES | {"protected_chunks": (queries.chunks, places.CHUNKS_SQL)}
