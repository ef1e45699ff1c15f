"""Query registrations, each with the SQL that checks it."""
