"""A bounded kernel for one PDF file at a time: values, filters, encryption, structure, walk and rewrite. No Spark here."""
