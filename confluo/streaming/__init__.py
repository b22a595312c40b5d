"""confluo.streaming"""
