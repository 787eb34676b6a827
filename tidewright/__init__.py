"""Series, spectra, system identification and evidence ledgers as Spark DataFrame operators."""
