"""confluo.sources"""
