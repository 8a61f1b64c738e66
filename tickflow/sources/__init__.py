"""Sources: Kafka / file streams, the serving-table reader and feeds derived from tables."""
