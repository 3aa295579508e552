"""Sources and sinks: landed workbook sheets, weather payloads, result tables."""
