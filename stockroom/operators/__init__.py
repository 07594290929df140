"""DataFrame -> DataFrame operators (filters, joins, reports, inventory, analysis)."""
