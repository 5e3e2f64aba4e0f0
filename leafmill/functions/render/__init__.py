"""Storage HTML of one page to markdown, and jobs that take references, macros and tasks out of it as rows."""
