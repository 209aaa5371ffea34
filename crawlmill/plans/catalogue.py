"""All queries outside the llm subpackage, and their SQL."""

from crawlmill.plans import general, reference

QUERIES = {**general.QUERIES, **reference.QUERIES}
SQL = {**general.SQL, **reference.SQL}
