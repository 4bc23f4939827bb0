"""Reading and writing features and tables: CSV with places, GeoJSON, KML, Arrow files, declared sinks."""
