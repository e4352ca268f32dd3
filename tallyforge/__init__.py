"""tallyforge: evidence reconciliation and corpus preparation as Spark DataFrame plans."""
