"""Stage plans, jobs and the registered queries."""
