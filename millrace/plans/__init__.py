"""The operators as queries over the star-schema tables, each with the SQL that an oracle runs."""
