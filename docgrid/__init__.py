"""docgrid: positioned text boxes of scanned invoices to clean line items, as DataFrame transformations."""
